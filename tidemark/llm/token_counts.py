"""Token counts of fields and sections by offset-mapped attribution.

The fields of a document are joined by blanks and encoded once, as a model would read them. The
bytes of each token give its span; spans are joined to the sections they meet by binary search over section
starts, and a token that meets several goes by a rule:

* ``first``: all to the section of its first character,
* ``most``: all to the section with most of its characters, the earlier of equals,
* ``split``: to each section by its share of the token's characters.

The blank between fields belongs to the section before it, so a token that takes it in is a shared one. So counts of a document's sections add up
to its tokens exactly (``split``: but for rounding of doubles).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch

#: Where the vocabulary lies on the driver, and its rule for cutting text before merging.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
JOINER = " "
RULES = ("first", "most", "split")


class Encoder:
    def __init__(self, vocabulary: bytes, pattern: str = PATTERN):
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in vocabulary.splitlines() if line)}
        self.encoding = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.length = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.length[rank] = len(token)

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Byte spans of the text's tokens."""
        ends = np.cumsum(self.length[np.asarray(self.encoding.encode_ordinary(text), dtype=np.int64)])
        return np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def sections(fields: list[str], lines: bool = True, joiner: str = JOINER) -> tuple[list[tuple[int, int, int]], np.ndarray]:
    """(field, section, code points) in order, and their first bytes in the joined text; empty fields have one empty section."""
    out, starts, at = [], [], 0
    for number, field in enumerate(fields):
        parts = field.split("\n") if lines else [field]
        for k, part in enumerate(parts):
            ended = part + "\n" if k < len(parts) - 1 else part
            out.append((number, k, len(ended)))
            starts.append(at)
            at += len(ended.encode())
        at += len(joiner.encode())
    return out, np.array(starts, np.int64)


def attribute(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section by ``rule``, and how many tokens that meet another section too begin in it."""
    n = len(first)
    # Of sections that begin at one byte all but the last are empty, and so get nothing.
    a = np.searchsorted(first, start, side="right") - 1
    b = np.searchsorted(first, end - 1, side="right") - 1
    shared = np.flatnonzero(b > a)
    tokens = np.bincount(a[b == a], minlength=n).astype(float)
    if len(shared):
        heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for k in shared:
            cuts = np.concatenate([[start[k]], first[a[k] + 1 : b[k] + 1], [end[k]]])
            chars = heads[cuts[1:]] - heads[cuts[:-1]]
            if rule == "split" and chars.sum():
                tokens[a[k] : b[k] + 1] += chars / chars.sum()
            else:
                tokens[a[k] + (int(chars.argmax()) if rule == "most" else 0)] += 1
    return tokens, np.bincount(a[shared], minlength=n)


def section_tokens(docs: DataFrame, fields: tuple[str, ...] = ("source", "lang", "text"), rule: str = "most", lines: bool = True, joiner: str = JOINER, vocabulary: str = VOCABULARY, pattern: str = PATTERN) -> DataFrame:
    """One row per section of each field of every row of ``docs`` (doc_id and the string columns ``fields``).

    Columns: doc_id, field, section, char_start, char_end (code points within the field), n_tokens (double),
    n_shared. With ``lines`` a field's lines, line ends included, are its sections, else the field is one.
    Null fields are empty; an empty field has one empty section, which can only hold the joiner's token. Whole texts are encoded; repeated rows are counted each for itself;
    other columns are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, pattern)
        for rows in batches:
            schema = pa.schema([rows.schema.field("doc_id"), ("field", pa.string()), ("section", pa.int64()), ("char_start", pa.int64()), ("char_end", pa.int64()), ("n_tokens", pa.float64()), ("n_shared", pa.int64())])
            done = 0
            while done < rows.num_rows:
                which, names, number, lo, hi, tokens, shared = [], [], [], [], [], [], []
                while done < rows.num_rows and len(which) < 20_000:
                    values = [rows.column(f)[done].as_py() or "" for f in fields]
                    joined = joiner.join(values)
                    parts, first = sections(values, lines, joiner)
                    start, end = encoder.spans(joined) if joined else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                    n, s = attribute(np.frombuffer(joined.encode(), np.uint8), start, end, first, rule)
                    at = 0
                    for field, k, size in parts:
                        at = 0 if k == 0 else at
                        names.append(fields[field])
                        number.append(k)
                        lo.append(at)
                        at += size
                        hi.append(at)
                    which += [done] * len(parts)
                    tokens.append(n)
                    shared.append(s)
                    done += 1
                yield batch(schema, doc_id=rows.column("doc_id").take(pa.array(which)), field=names, section=number, char_start=lo, char_end=hi, n_tokens=np.concatenate(tokens), n_shared=np.concatenate(shared).astype(np.int64))

    return docs.select("doc_id", *[F.col(f).cast("string").alias(f) for f in fields]).mapInArrow(run, f"doc_id {kind}, field string, section bigint, char_start bigint, char_end bigint, n_tokens double, n_shared bigint")


def with_token_lengths(docs: DataFrame, text: str = "text", out: str = "n_tokens", vocabulary: str = VOCABULARY, pattern: str = PATTERN, keep: bool = True) -> DataFrame:
    """``docs`` with the number of tokens of a text column (null: none), encoded whole; other columns go through as they are.

    Without ``keep`` the text itself stays behind.
    """
    sent = docs.sparkSession.sparkContext.broadcast(_vocabulary(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, pattern)
        for rows in batches:
            counts = [len(encoder.encoding.encode_ordinary(value.as_py() or "")) for value in rows.column(text)]
            names = [n for n in rows.schema.names if keep or n != text]
            yield pa.RecordBatch.from_arrays([*[rows.column(n) for n in names], pa.array(counts, pa.int64())], names=[*names, out])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if keep or f.name != text)
    return docs.mapInArrow(run, f"{fields}, `{out}` bigint")


def _vocabulary(path: str) -> bytes:
    """Read once on the driver and sent along; the path is the driver's own."""
    if not os.path.isfile(path):
        raise FileNotFoundError(f"no vocabulary at {path} on the driver; pass its path as vocabulary=")
    with open(path, "rb") as file:
        return file.read()
