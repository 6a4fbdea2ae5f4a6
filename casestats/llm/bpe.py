"""Byte-level BPE with reuse of content-defined chunks.

Texts are cut where a rolling hash of the last characters says so, so equal passages give
equal chunks wherever they stand. A worker encodes a chunk once and keeps the ids of its
inside (a bounded store, least recently used chunks go first). What lies around a cut, from the last word start before it to the first one after
it, is encoded anew as one string. The repair stands if the same string with one more word on
either side encodes to the same ids between those of the two words; else the two chunks are
joined and encoded as one. Results equal encoding whole texts, whatever was kept.

Nothing is shuffled: reuse is per worker, memory is bounded, a lost executor loses only time.

NULL counts as empty: no ids, the hashes of nothing. Special tokens inside a text become their
ids, as the library does. Repeated rows get equal results.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections import OrderedDict
from collections.abc import Iterator
from itertools import islice
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from casestats.llm.common import KEY, keyed, once, slices

# Rolling hash: characters in the window, a cut every 2**CUT_BITS or so, least and greatest size.
WINDOW, CUT_BITS, LEAST, MOST = 16, 10, 256, 8192
FACTOR = 0x9E3779B97F4A7C15
CHUNK_BYTES = 48_000_000
NEAR_END = 120

# Characters for which words are found here as the library finds them; others go to the library.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN = re.compile(rf"[\t\n -~{LETTERS}]*")
# Fixed value: the pattern of byte-level vocabularies.
PATTERN = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
# A word start that holds whatever stands around it: letter, blank, letter.
ANCHOR = re.compile(rf"(?<=[{LETTERS}]) (?=[{LETTERS}])")


def _powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, "uint64")
    out[:1] = 1
    return np.cumprod(out)


class Cutter:
    """Positions of content-defined cuts."""

    def __init__(self):
        self.up = self.down = np.empty(0, "uint64")

    def cuts(self, text: str) -> list[int]:
        n = len(text)
        if n <= LEAST:
            return [n]
        if n > len(self.up):
            self.up = _powers(2 * n, FACTOR)
            self.down = _powers(2 * n, pow(FACTOR, -1, 1 << 64))
        chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("uint64")
        sums = np.cumsum(chars * self.down[:n])
        h = (sums[WINDOW:] - sums[:-WINDOW]) * self.up[WINDOW:n]
        marks = np.flatnonzero((h >> np.uint64(64 - CUT_BITS)) == 0) + WINDOW + 1
        out, last = [], 0
        for mark in [*marks.tolist(), n]:
            while mark - last > MOST:
                last += MOST
                out.append(last)
            if mark - last >= LEAST or mark == n and mark > last:
                out.append(mark)
                last = mark
        return out


class Coder:
    """Encodes and decodes with a tokenizer given as its JSON text."""

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        said = json.loads(vocabulary)
        self.special = [t["content"] for t in said["added_tokens"]]
        back = {c: b for b, c in _byte_letters().items()}
        self.bytes_of = {
            i: bytes(back[c] for c in token) for token, i in said["model"]["vocab"].items()
        }
        self.bytes_of |= {t["id"]: t["content"].encode() for t in said["added_tokens"]}
        self.number_of = {i: b"%d" % i for i in self.bytes_of}
        self.fast = _merger(said)
        self.chunks: OrderedDict[str, tuple] = OrderedDict()
        self.kept = 0
        self.cutter = Cutter()

    def encode(self, text: str) -> bytes:
        """Ids (uint32) without chunks: by the fast merger where words are certain to be cut
        the same way, else by the library."""
        if not text:
            return b""
        if self.fast and PLAIN.fullmatch(text) and not any(s in text for s in self.special):
            ids = self.fast.encode_ordinary(text)
        else:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes()

    def decimal(self, ids: list[int]) -> bytes:
        return b",".join(map(self.number_of.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")

    def chunk(self, text: str):
        """(first two word starts, last two, ids between, ids of the words next to the ends)
        of a chunk, or None if it has too few word starts."""
        if text in self.chunks:
            self.chunks.move_to_end(text)
            return self.chunks[text]
        at = [m.start() for m in islice(ANCHOR.finditer(text), 4)]
        if len(at) < 4:
            return None
        near_end = [m.start() for m in ANCHOR.finditer(text, max(at[1] + 1, len(text) - NEAR_END))]
        if len(near_end) < 2:
            near_end = [m.start() for m in ANCHOR.finditer(text, at[1] + 1)]
        (a, b), (y, z) = at[:2], near_end[-2:]
        first, last = self.encode(text[a:b]), self.encode(text[y:z])
        out = (a, b, y, z, first + self.encode(text[b:y]) + last, first, last)
        self.chunks[text] = out
        self.kept += 2 * len(text) + len(out[4]) + 500
        while self.kept > CHUNK_BYTES:
            old, gone = self.chunks.popitem(last=False)
            self.kept -= 2 * len(old) + len(gone[4]) + 500
        return out

    def encode_text(self, text: str) -> bytes:
        out: list[bytes] = []
        left = ""  # since the last word start that is settled
        context, ids = "", b""  # the word before it and its ids
        start = 0
        for end in self.cutter.cuts(text):
            piece = text[start:end]
            start = end
            found = self.chunk(piece)
            if found is None:
                left += piece
                continue
            a, b, y, z, inside, first, last = found
            seam = self.encode(left + piece[:a])
            around = self.encode(context + left + piece[:b])
            if around == ids + seam + first:
                out += [seam, inside]
                left, context, ids = piece[z:], piece[y:z], last
            else:
                left += piece
        out.append(self.encode(left))
        return b"".join(out)


def _merger(said: dict):
    """The same vocabulary for a faster library, if its merges stand in the order of ids and
    its words are cut by the usual pattern; else None."""
    model, split = said["model"], said["pre_tokenizer"]
    merges = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    in_order = all(model["vocab"].get(m.replace(" ", "")) == 256 + i for i, m in enumerate(merges))
    usual = split == {
        "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True,
    }
    if not (in_order and usual and said["normalizer"] is None and not model.get("ignore_merges")):
        return None
    import tiktoken

    back = {c: b for b, c in _byte_letters().items()}
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the rest for those from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, after = {}, 256
    for b in range(256):
        out[b] = chr(b if b in shown else after)
        after += b not in shown
    return out


def coder(vocabulary: str) -> Coder:
    """One per worker and vocabulary."""
    name = hashlib.md5(vocabulary.encode()).hexdigest()
    return once(name, lambda: Coder(vocabulary))


def encode_documents(docs: DataFrame, vocabulary_file: str, with_ids: bool = False) -> DataFrame:
    """doc_id, text_key, n_tokens, ids_sha256, decoded_sha256, and with `with_ids` the ids
    themselves (uint32, little-endian)."""
    vocabulary = docs.sparkSession.sparkContext.broadcast(Path(vocabulary_file).read_text())

    def encoded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = coder(vocabulary.value)
        for batch in slices(batches):
            rows = []
            for text in batch["text"]:
                ids = own.encode_text(text or "")
                listed = array("I", ids).tolist()
                rows.append(
                    (
                        len(listed),
                        hashlib.sha256(own.decimal(listed)).hexdigest(),
                        hashlib.sha256(own.decode(listed).encode()).hexdigest(),
                        *([ids] if with_ids else []),
                    )
                )
            names = ["n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]
            out = pd.DataFrame(rows, columns=names, index=batch.index)
            yield pd.concat([batch[KEY], out], axis=1)

    schema = "doc_id long, text_key long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return keyed(docs).mapInPandas(encoded, schema + ", ids binary" * with_ids)
