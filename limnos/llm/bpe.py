"""BPE encoding and decoding by per-prefix dynamic programming.

For each prefix of a word exactly one token can be the last of its encoding. An automaton over the vocabulary lists the
tokens that end at a position; a token is that last one if it starts the word, or if it and the last token of what
precedes it stay apart when the pair is encoded. Back-pointers from the word's end give the ids."""

from __future__ import annotations

import hashlib
import json
import struct
import unicodedata

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

#: Words and chunks that a task remembers, at most; a full memory is emptied.
REMEMBERED = 200_000


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 stays, the others follow from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Merges:
    """A vocabulary with ranked merges; words end in `end`, which belongs to their last letter."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], end: str) -> None:
        import ahocorasick

        self.end, self.names = end, {i: t for t, i in vocab.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b) in enumerate(merges):
            x, y, z = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((x, y), r)
            self.parts.setdefault(z, (r, x, y))
        self.apart: dict[tuple[int, int], bool] = {}
        self.auto = ahocorasick.Automaton()
        for t, i in vocab.items():
            letters = self.letters(t)
            if i not in self.parts and len(letters) > 1:
                continue  # no merge makes it
            self.auto.add_word(letters, (len(letters), i))
        self.auto.make_automaton()

    def letters(self, token: str) -> str:
        """The token with its word-end mark folded into the last letter, so that a letter at a word's end is another symbol."""
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            token = token[: -len(self.end)]
            return token[:-1] + chr(ord(token[-1]) + 0x1000)
        return token

    def stays_apart(self, left: int, right: int) -> bool:
        """Whether encoding the pair's letters gives the pair. Undo the pair's inner merges, latest first: at each step the tokens that
        face each other across the seam must not have merged before the later of the merges that hid them."""
        known = self.apart.get((left, right))
        if known is not None:
            return known
        a, b, until_a, until_b, out = left, right, 1 << 60, 1 << 60, True
        while True:
            # a and b face each other until a merge takes a to the left (rank until_a) or b to the right (until_b).
            # Of equal ranks the leftmost goes first: the one that takes a, but not the one that takes b, is before the seam's.
            met = self.rank.get((a, b))
            if met is not None and met < until_a and met <= until_b:
                out = False
                break
            pa, pb = self.parts.get(a), self.parts.get(b)
            if pa is None and pb is None:
                break
            # go back in time: the token made last is taken apart, of two alike the right one
            if pb is None or (pa is not None and pa[0] > pb[0]):
                until_a, a = pa[0], pa[2]
            else:
                until_b, b = pb[0], pb[1]
        if len(self.apart) > 300_000:
            self.apart.clear()
        self.apart[left, right] = out
        return out

    def encode_word(self, word: str) -> list[int]:
        """Ids of one pre-token, given in the vocabulary's letters."""
        text = word[:-1] + chr(ord(word[-1]) + 0x1000) if self.end else word
        n = len(text)
        last: list[int] = [-1] * n
        size: list[int] = [0] * n
        apart, slow = self.apart, self.stays_apart
        for at, (k, i) in self.auto.iter(text):
            before = at - k
            if last[at] >= 0:
                continue
            if before >= 0:
                left = last[before]
                if left < 0:
                    continue
                ok = apart.get((left, i))
                if not (slow(left, i) if ok is None else ok):
                    continue
            last[at], size[at] = i, k
        out, at = [], n - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError(f"no encoding: {word!r}")
            out.append(last[at])
            at -= size[at]
        return out[::-1]


class WordBpe:
    """Encodes and decodes as the tokenizer file at `path` says: NFC, white space to one space, lower case, split, byte letters, merges."""

    def __init__(self, path: str, remembered: int = REMEMBERED) -> None:
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.merges = Merges(model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model.get("end_of_word_suffix") or "")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = self.merges.names | {i: t for t, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.find = regex.compile(split["pattern"]["Regex"]).findall
        self.bytes = byte_letters()
        self.remembered = remembered
        # ids alone: the decoded text is looked up by them
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def normal(self, text: str) -> str:
        text = text if text.isascii() else unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()  # letter by letter: no special final sigma

    def word(self, word: str) -> bytes:
        """Of one normalised pre-token: ids as little-endian 32 bits. Plain letters are a chunk as they stand, and remembered once as both."""
        held = self.chunks if word.isascii() and word.isalpha() else self.words
        out = held.get(word)
        if out is None:
            ids = self.merges.encode_word("".join([self.bytes[b] for b in word.encode("utf-8", "surrogatepass")]))
            out = struct.pack(f"<{len(ids)}I", *ids)
            if len(held) >= self.remembered:
                held.clear()
            held[word] = out
        return out

    def chunk(self, chunk: str) -> bytes:
        """The same of a text without spaces: often a word, or a word and one mark."""
        text = self.normal(chunk)
        if text.isalpha():
            out = self.word(text)
        elif text[:-1].isalpha() and text[-1] in ",.":
            out = self.word(text[:-1]) + self.word(text[-1])
        else:
            out = b"".join([self.word(w) for w in self.find(text)])
        if len(self.chunks) >= self.remembered:
            self.chunks.clear()
        self.chunks[chunk] = out
        return out

    def encode(self, text: str | None) -> tuple[int, bytes, bytes]:
        """Number of ids, ids, decoded text of a whole text. White space separates pre-tokens and composes with nothing, so plain spaces and line ends cut the text into chunks that are remembered."""
        found: list[bytes] = []
        get, slow = self.chunks.get, self.chunk
        for k, part in enumerate(self.cut.split(text or "") if self.cut and "<|" in (text or "") else [text or ""]):
            if k % 2:
                found.append(struct.pack("<I", self.special[part]))
            else:
                found += [get(c) or slow(c) for c in part.replace("\n", " ").split(" ") if c]
        ids = b"".join(found)
        n = len(ids) // 4
        return n, ids, " ".join(map(self.names.__getitem__, struct.unpack(f"<{n}I", ids))).encode()

    def decode(self, ids: list[int]) -> str:
        """Tokens joined by a space, as a tokenizer without a decoder does; unknown ids are passed over."""
        return " ".join(self.names[i] for i in ids if i in self.names)


def encode_texts(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = True, remembered: int = REMEMBERED) -> DataFrame:
    """Encodes and decodes every whole text: id, n_tokens, ids_sha256, decoded_sha256 and with keep_ids ids (array<int>) and decoded.

    vocabulary: path of a tokenizer file, readable on each executor. Null texts are empty ones: no token. Null and repeated ids stay; other columns are not read.
    remembered: words and chunks that a task holds; fewer take less memory (some 30 MB for each 100,000) and more time."""
    import array

    names = ["id", "n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if keep_ids else [])

    def step(b: dict, bpe: WordBpe) -> dict:
        out: dict[str, list] = {k: [] for k in names}
        for key, text in zip(b["id"], b["text"]):
            n, ids, decoded = bpe.encode(text)
            row = [key, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest()]
            for k, v in zip(names, row + ([array.array("I", ids).tolist(), decoded.decode()] if keep_ids else [])):
                out[k].append(v)
        return out

    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return map_batches(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), step, schema, lambda: WordBpe(vocabulary, remembered)).withColumnRenamed("id", id_col)
