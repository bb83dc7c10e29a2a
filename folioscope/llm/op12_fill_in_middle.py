"""Fill-in-middle: documents rearranged by rotating blocks in place, and put back.

A document is cut into units (runs of letters, or one other character) and two cuts divide
it into prefix, middle and suffix. The text lies in one bytearray: the scan finds the cuts,
the sentinels are inserted before the three parts, and the parts change places by rotating
neighbouring blocks, each rotation being three reversals. Undoing the same rotations and
taking the sentinels out restores the text exactly, which is checked by hash.

    psm   <P>prefix<S>suffix<M>middle
    spm   <S>suffix<P>prefix<M>middle
    plain the text itself

Cuts and form depend on the document's ID alone, so every run gives the same. A null ID
is taken as an empty one. Null and empty texts, and those that hold a sentinel, stay plain.
Rows equal in ID and text get equal results. Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.shared import byte_texts, keyed, prepare, table

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
SENTINELS = (PREFIX, SUFFIX, MIDDLE)
PLAIN_FROM, SPM_BELOW = 90, 20       # of a hundred: documents left plain, and spm of the rest


def numbers(doc_id: int | None, seed: int = 1) -> list[int]:
    """Four numbers of 32 bits that a document's ID and the seed fix."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in (0, 4, 8, 12)]


def unit_starts(text: bytes) -> np.ndarray:
    """Where each unit of a text starts: `[A-Za-z]+|[^A-Za-z]` over code points."""
    data = np.frombuffer(text, np.uint8)
    lower = data | 32
    letter = (lower >= 97) & (lower <= 122) & (data < 128)
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.flatnonzero(~inside & (data & 0xC0 != 0x80))


def code_points(part: bytes) -> int:
    data = np.frombuffer(part, np.uint8)
    return int((data & 0xC0 != 0x80).sum())


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Exchange the blocks [start, middle) and [middle, end) in place, by three reversals."""
    view = np.frombuffer(data, np.uint8)
    for a, b in ((start, middle), (middle, end), (start, end)):
        view[a:b] = view[a:b][::-1].copy()


def rearranged(text: bytes, cuts: tuple[int, int], form: str) -> bytes:
    """A text with its middle, between two byte places, moved to the end."""
    if form == "plain":
        return text
    data = bytearray(text)
    for at, sentinel in ((len(text), SUFFIX), (cuts[0], MIDDLE), (0, PREFIX)):
        data[at:at] = sentinel
    middle = cuts[0] + len(PREFIX)                     # <P>prefix|<M>middle|suffix<S>
    suffix = cuts[1] + len(PREFIX) + len(MIDDLE)
    rotate(data, suffix, len(data) - len(SUFFIX), len(data))       # |<S>suffix
    rotate(data, middle, suffix, len(data))            # <P>prefix|<S>suffix|<M>middle
    if form == "spm":
        rotate(data, 0, middle, middle + len(data) - suffix)
    return bytes(data)


def restored(output: bytes, form: str) -> bytes:
    """The text that `rearranged` was given, from its result and the form."""
    if form == "plain":
        return output
    data = bytearray(output)
    last = output.index(MIDDLE)
    if form == "spm":
        rotate(data, 0, output.index(PREFIX), last)
    start = data.index(SUFFIX)
    rotate(data, start, last, len(data))               # <P>prefix|<M>middle|<S>suffix
    for sentinel in SENTINELS:
        at = data.index(sentinel)
        del data[at:at + len(sentinel)]
    return bytes(data)


SCHEMA = ("doc_id long, n long, form string, prefix_chars long, middle_chars long, "
          "output binary")


def transform(docs: DataFrame, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW,
              seed: int = 1) -> DataFrame:
    """Per document its units, form, the sizes of its parts, and the rearranged text."""
    prepare(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), byte_texts(batch)):
                starts = unit_starts(text)
                n = len(starts)
                if not text or any(s in text for s in SENTINELS):
                    out.append((n, "plain", None, None, text))
                    continue
                h = numbers(doc_id, seed)
                ends = np.append(starts, len(text))
                a, b = sorted(int(ends[x % (n + 1)]) for x in h[:2])
                form = ("plain" if h[2] % 100 >= plain_from
                        else "spm" if h[3] % 100 < spm_below else "psm")
                sizes = (None, None) if form == "plain" else (
                    code_points(text[:a]), code_points(text[a:b]))
                out.append((n, form, *sizes, rearranged(text, (a, b), form)))
            columns = list(zip(*out)) or [[]] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

    return keyed(docs).select("doc_id", "text").mapInArrow(work, SCHEMA)


def restore(moved: DataFrame) -> DataFrame:
    """The rows of `transform` with the text rebuilt from output and form alone."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restored(o, f) for o, f in zip(batch.column("output").to_pylist(),
                                                    batch.column("form").to_pylist())]
            yield batch.append_column("restored", pa.array(texts, pa.binary()))

    return moved.mapInArrow(work, SCHEMA + ", restored binary")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return restore(transform(table(spark, sf_dir, "documents"))).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


ORACLE_SQL = """
with hashed as (
  select doc_id, coalesce(text, '') as t,
         sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
units as (
  select doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') as u,
         cast('0x' || h[1:8] as bigint) as h1, cast('0x' || h[9:16] as bigint) as h2,
         cast('0x' || h[17:24] as bigint) as h3, cast('0x' || h[25:32] as bigint) as h4
  from hashed),
cut as (
  select doc_id, t, u, len(u) as n,
         case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>')
                   or h3 % 100 >= 90 then 'plain'
              when h4 % 100 < 20 then 'spm' else 'psm' end as form,
         least(h1 % (len(u) + 1), h2 % (len(u) + 1)) as a,
         greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) as b from units),
parts as (
  select doc_id, t, n, form, array_to_string(u[1:a], '') as p,
         array_to_string(u[a + 1:b], '') as m, array_to_string(u[b + 1:n], '') as s from cut)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
       case when form <> 'plain' then length(m) end as middle_chars,
       sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
              else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
       sha256(t) as restored_sha256
from parts"""
