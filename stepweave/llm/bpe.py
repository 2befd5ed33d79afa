"""BPE encoding and decoding by content-defined chunk reuse.

A rolling hash over the bytes cuts every text where its value meets a mask, at the next beginning of ASCII white space,
so a passage is cut alike in every document. The tokenizers library encodes each different chunk once; a memo bounded by
bytes keeps the ids for the documents that come later in the task.

Then every join of two chunks is repaired by re-encoding. The last word of the left chunk, the first word of the right
one and both together are encoded: where the ids agree with each other and with the ends of the chunks' own ids, the
chunks' ids may stand side by side. Where they do not, the stretch about the join grows outward, word by word doubled,
until its outer halves get the same ids alone, in the stretch and in the chunks; the stretch's ids then replace theirs.
In the end the stretch is both chunks as a whole. So nothing is assumed about the tokenizer's normaliser or pre-tokenizer.

Defined results: a null or empty text, or one of white space alone, has the ids that the library gives to '' or to that
white space, and decodes to what the library makes of them. Repeated rows give repeated rows. A text without white space
is one chunk, however long. Other columns of the input are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stepweave.llm.common import BYTE_CODE, IS_SPACE, documents, raw_bytes, rolled, slices

#: One cut in 2 ** CUT_BITS bytes on average; the hash sees this many bytes.
CUT_BITS, CUT_WIDTH = 9, 16
#: Bytes of chunks and ids in one generation of a task's memo, and of text that the library is given at a time (few, so that its answers stay in the processor's cache).
MEMO_BYTES, CALL_BYTES = 48_000_000, 20_000
_SPACE = b" \t\n\x0b\x0c\r"


def chunk_edges(raw: np.ndarray, offsets: np.ndarray, cut_bits: int = CUT_BITS) -> np.ndarray:
    """Ascending edges of the chunks of all rows; the rows' offsets are among them."""
    h = rolled(BYTE_CODE[raw], CUT_WIDTH)
    cuts = np.flatnonzero((h & np.uint64((1 << cut_bits) - 1)) == 0) + CUT_WIDTH
    space = IS_SPACE[raw]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    begins = np.flatnonzero(begins)
    at = np.searchsorted(begins, cuts)
    cuts, at = cuts[at < len(begins)], begins[at[at < len(begins)]]
    same_row = np.searchsorted(offsets, cuts, side="right") == np.searchsorted(offsets, at, side="right")
    return np.unique(np.concatenate([offsets, at[same_row]]))


class Memo(dict):
    """A memo of two generations, bounded by bytes: when the young one is full it becomes the old one."""

    def __init__(self, most: int = MEMO_BYTES):
        super().__init__()
        self.most, self.size, self.old = most, 0, {}

    def seek(self, key):
        value = self.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if self.size > self.most:
            self.old, self.size = dict(self), 0
            self.clear()
        self[key] = value
        self.size += len(key) + len(value) + 200


def tail(text: bytes, words: int) -> bytes:
    """The last words of a text, from the beginning of the white space before them; all of it if it has no more words."""
    end = len(text)
    for _ in range(words):
        body = len(text[:end].rstrip(_SPACE))
        at = max(text.rfind(s, 0, body) for s in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r")) if body else -1
        if at < 0:
            return text
        end = len(text[: at + 1].rstrip(_SPACE))
    return text[end:]


def head(text: bytes, words: int) -> bytes:
    """The first words of a text, up to the white space after them."""
    at = 0
    for _ in range(words):
        while at < len(text) and text[at] in _SPACE:
            at += 1
        while at < len(text) and text[at] not in _SPACE:
            at += 1
    return text[:at]


#: Characters below this one have no combining marks among them.
SIMPLE = "\u0180"


def _one_space(text: str) -> str:
    for c in "\t\n\x0b\x0c\r\x85\xa0":
        text = text.replace(c, " ")
    while "  " in text:
        text = text.replace("  ", " ")
    return text


def simple_normaliser(tokenizer) -> Callable[[str], str] | None:
    """The tokenizer's normaliser for texts of simple characters in Python's own string functions, several times faster.

    It is put together from the steps that the tokenizer states, and compared with the library's result for every simple
    character; None if there is a step that is not known here, or any difference, or nothing to do.
    """
    spec = json.loads(tokenizer.to_str())
    rule = spec["normalizer"]
    steps = [] if rule is None else rule["normalizers"] if rule["type"] == "Sequence" else [rule]
    if not steps or any(t["normalized"] for t in spec["added_tokens"]):
        return None
    made: list[Callable[[str], str]] = []
    for step in steps:
        if step["type"] == "Lowercase":
            made.append(str.lower)
        elif step["type"] == "Replace" and step["pattern"] == {"Regex": "\\s+"} and step["content"] == " ":
            made.append(_one_space)
        elif step["type"] != "NFC":
            return None

    def run(text: str) -> str:
        for step in made:
            text = step(text)
        return text

    simple = [chr(c) for c in range(ord(SIMPLE))]
    probe = "".join(simple) + "".join(f"a{c}b {c}{c} {c.swapcase()}" for c in simple)
    return run if run(probe) == tokenizer.normalizer.normalize_str(probe) else None


class Encoder:
    """Ids, as packed int32, of whole texts over one tokenizer."""

    def __init__(self, tokenizer, cut_bits: int = CUT_BITS, most: int = MEMO_BYTES):
        from tokenizers import Tokenizer, normalizers

        self.tokenizer, self.cut_bits = tokenizer, cut_bits
        self.chunks, self.ends = Memo(most), Memo(most // 4)
        self.normalise = simple_normaliser(tokenizer)
        if self.normalise:  # the same tokenizer for texts that are normalised already
            self.bare = Tokenizer.from_str(tokenizer.to_str())
            self.bare.normalizer = normalizers.Sequence([])
            marks = "|".join(re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values())
            self.marked = re.compile(marks) if marks else None
            self.odd = re.compile(f"[{SIMPLE}-\U0010ffff]")

    def library(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of each piece: what the library's encode() gives."""
        texts = [p.decode() for p in pieces]
        if not self.normalise:
            return self.ids_of(self.tokenizer, texts)
        ready = [None if self.odd.search(t) else self.normalise(t) for t in texts]
        if self.marked:  # special tokens are looked for before a text is normalised, and only then
            ready = [None if r is None or self.marked.search(t) or self.marked.search(r) else r for t, r in zip(texts, ready, strict=True)]
        simple = iter(self.ids_of(self.bare, [r for r in ready if r is not None]))
        other = iter(self.ids_of(self.tokenizer, [t for t, r in zip(texts, ready, strict=True) if r is None]))
        return [next(other) if r is None else next(simple) for r in ready]

    @staticmethod
    def ids_of(tokenizer, texts: list[str]) -> list[bytes]:
        return [array("i", e.ids).tobytes() for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def known(self, pieces: list[bytes], memo: Memo) -> dict[bytes, bytes]:
        """Ids of each different piece; those that the memo lacks are encoded, CALL_BYTES at a time."""
        out, new, size = {}, [], 0
        for p in pieces:
            if p not in out:
                out[p] = memo.seek(p)
                if out[p] is None:
                    new.append(p)
        some: list[bytes] = []
        for p in [*new, None]:
            if p is None or size > CALL_BYTES:
                for q, ids in zip(some, self.library(some), strict=True):
                    out[q] = ids
                    memo.keep(q, ids)
                some, size = [], 0
            if p is not None:
                some.append(p)
                size += len(p)
        return out

    def texts(self, raw: np.ndarray, offsets: np.ndarray) -> Iterator[bytes]:
        data = raw.tobytes()
        edges = chunk_edges(raw, offsets, self.cut_bits)
        bounds = edges.tolist()
        pieces = [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        ids = self.known(pieces, self.chunks)
        at = np.searchsorted(edges, offsets).tolist()
        joins = [j for a, b in zip(at[:-1], at[1:], strict=True) for j in range(a + 1, b)]
        lasts, firsts = {j: tail(pieces[j - 1], 1) for j in joins}, {j: head(pieces[j], 1) for j in joins}
        near = self.known([x for j in joins for x in (lasts[j], firsts[j], lasts[j] + firsts[j])], self.ends)
        apart = set()
        for j in joins:
            left, right = near[lasts[j]], near[firsts[j]]
            if near[lasts[j] + firsts[j]] != left + right or not ids[pieces[j - 1]].endswith(left) or not ids[pieces[j]].startswith(right):
                apart.add(j)
        for a, b, start, end in zip(at[:-1], at[1:], offsets[:-1], offsets[1:], strict=True):
            if start == end:
                yield self.known([b""], self.chunks)[b""]
            elif apart and any(j in apart for j in range(a + 1, b)):
                text, found = pieces[a], ids[pieces[a]]
                for j in range(a + 1, b):
                    found = found + ids[pieces[j]] if j not in apart else self.joined(text, found, pieces[j], ids[pieces[j]])
                    text += pieces[j]
                yield found
            else:
                yield b"".join([ids[p] for p in pieces[a:b]])

    def joined(self, left: bytes, left_ids: bytes, right: bytes, right_ids: bytes) -> bytes:
        """Ids of left + right: a stretch about the join is re-encoded, further outward until it agrees with what lies outside."""
        words = 2
        while True:
            a, b = tail(left, words), head(right, words)
            if len(a) == len(left) and len(b) == len(right):
                return self.library([left + right])[0]
            inner_a, inner_b = tail(a, words // 2), head(b, words // 2)
            outer_a, outer_b = a[: len(a) - len(inner_a)], b[len(inner_b) :]
            own_a, own_b, outer_a, outer_b, both = self.library([a, b, outer_a, outer_b, a + b])
            settled_a = len(a) == len(left) or (outer_a and left_ids.endswith(own_a) and own_a.startswith(outer_a) and both.startswith(outer_a))
            settled_b = len(b) == len(right) or (outer_b and right_ids.startswith(own_b) and own_b.endswith(outer_b) and both.endswith(outer_b))
            if settled_a and settled_b:
                before = b"" if len(a) == len(left) else left_ids[: len(left_ids) - len(own_a)]
                return before + both + (b"" if len(b) == len(right) else right_ids[len(own_b) :])
            words *= 2


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallel part; more threads keep more memory
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = Encoder(load(path))
        for batch in slices(batches, "text", 2_000_000):
            ids = list(encoder.texts(*raw_bytes(batch.column("text"))))
            ends = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            flat = pa.Array.from_buffers(pa.int32(), int(ends[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends), flat)], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, ids array<int>: what the library's encode(text, add_special_tokens=False) gives."""
    return docs.select("doc_id", "text").mapInArrow(_encoding(tokenizer_path), "doc_id long, ids array<int>")


def _decoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        tokenizer = load(path)
        plain = tokenizer.decoder is None  # the library then joins the tokens by spaces
        names = np.array([tokenizer.id_to_token(i) or "" for i in range(max(tokenizer.get_vocab().values()) + 1)], object) if plain else None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                rows = batch.column("ids")
                texts = [" ".join(names[x.values.to_numpy(zero_copy_only=False)]) if plain else tokenizer.decode(x.as_py(), skip_special_tokens=False) for x in rows]
                yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns)], pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """Adds `decoded`, the library's decode(ids, skip_special_tokens=False)."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoding(tokenizer_path), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """encode() and decode() in one pass of one Python worker: doc_id, ids and decoded."""
    encoding, decoding = _encoding(tokenizer_path), _decoding(tokenizer_path)
    return docs.select("doc_id", "text").mapInArrow(lambda batches: decoding(encoding(batches)), "doc_id long, ids array<int>, decoded string")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = round_trip(documents(spark, sf_dir), tokenizer_path())
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
