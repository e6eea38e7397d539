"""Fill-in-the-middle training texts, made by DuckDB inside Arrow batches.

Spark deals out the rows; a task registers each batch as a DuckDB table and one
SQL statement does the work for all its rows: ``regexp_extract_all`` cuts texts
into tokens, SHA-256 of seed and id gives the random numbers, ``list_slice`` and
``array_to_string`` make prefix, middle and suffix, and the result goes back as
Arrow.  No Python runs for a row.  Every row's result depends on its id and text
alone, so a task that is run again gives the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from polycat.llm.arrays import LONG_BYTES, SPACE, is_long, sliced, steps, text_bytes, valid

#: A token: white space and the word after it; white space at the end is a token of its own.
TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
#: What marks the start of prefix, suffix and middle.
MARKS = ("<P>", "<S>", "<M>")
#: Rows of a step at most.
ROWS = 1 << 16

# Tables: ids (row, id) has a row for each text, pieces (row, piece, text) one for each of its pieces.  A piece ends
# where a token ends, so pieces are cut on their own; only those that a cut falls into are made into lists again.
FORMAT = f"""
WITH counted AS MATERIALIZED (
  SELECT row, piece, len(regexp_extract_all(text, '{TOKEN}')) AS n, contains(text, $p) OR contains(text, $s) OR contains(text, $m) AS marked FROM pieces),
whole AS (
  SELECT row, sum(n)::BIGINT AS n, bool_or(marked) AS marked FROM counted GROUP BY row),
drawn AS (
  SELECT row, n, marked, list_transform([1, 9, 17, 25], lambda k: ('0x' || substr(h, k, 8))::BIGINT) AS h
  FROM (SELECT row, n, marked, sha256($seed || ':' || id) AS h FROM whole JOIN ids USING (row))),
planned AS (
  SELECT row, n, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
         CASE WHEN n = 0 OR marked OR h[3] % 100 >= $rate THEN 'plain' WHEN h[4] % 100 < $spm THEN 'spm' ELSE 'psm' END AS form FROM drawn),
placed AS (
  SELECT row, piece, c.n AS n, greatest(least(a - before, c.n), 0) AS a, greatest(least(b - before, c.n), 0) AS b
  FROM (SELECT *, sum(n) OVER (PARTITION BY row ORDER BY piece) - n AS before FROM counted) c JOIN planned USING (row)),
cut AS (
  SELECT row, piece,
    CASE WHEN a = 0 THEN '' WHEN a = n THEN text ELSE array_to_string(list_slice(regexp_extract_all(text, '{TOKEN}'), 1, a), '') END AS prefix,
    CASE WHEN a = b THEN '' WHEN a = 0 AND b = n THEN text ELSE array_to_string(list_slice(regexp_extract_all(text, '{TOKEN}'), a + 1, b), '') END AS middle,
    CASE WHEN b = n THEN '' WHEN b = 0 THEN text ELSE array_to_string(list_slice(regexp_extract_all(text, '{TOKEN}'), b + 1, n), '') END AS suffix
  FROM placed JOIN pieces USING (row, piece)),
parts AS (
  SELECT row, string_agg(prefix, '' ORDER BY piece) AS prefix, string_agg(middle, '' ORDER BY piece) AS middle, string_agg(suffix, '' ORDER BY piece) AS suffix
  FROM cut GROUP BY row)
SELECT row, n, form,
  CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  CASE form WHEN 'plain' THEN concat(prefix, middle, suffix)
    WHEN 'psm' THEN concat($p, prefix, $s, suffix, $m, middle) ELSE concat($s, suffix, $p, prefix, $m, middle) END AS output
FROM parts JOIN planned USING (row) ORDER BY row
"""

# Table: made (row, form, output).  A text with a mark in it is plain, and no part can make one with the mark beside it
# (a mark begins with the one '<' it has), so each mark is found where it was set.
RESTORED = """
SELECT row, form, output,
  CASE form WHEN 'plain' THEN output WHEN 'psm' THEN concat(sides[1], middle, sides[2]) ELSE concat(sides[2], middle, sides[1]) END AS restored
FROM (SELECT row, form, output, around[2] AS middle, string_split(substr(around[1], length($p) + 1), CASE form WHEN 'psm' THEN $s ELSE $p END) AS sides
      FROM (SELECT row, form, output, CASE WHEN form <> 'plain' THEN string_split(output, $m) END AS around FROM made))
"""


def _session():
    """A DuckDB of one thread in memory: Spark has a task for each core, and nothing is put on a worker's own disk."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "temp_directory": ""})


def token_ends(data: np.ndarray, limit: int = LONG_BYTES) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``limit`` that cover one text and end where a token does; a longer token is in one of them."""
    at, n = 0, len(data)
    while at < n:
        end = min(at + limit, n)
        seen = False  # a byte of a word, after which the next white space begins a token
        while end < n:
            space = SPACE[data[end - 1 : end + (1 << 16)]]
            edge = np.flatnonzero(space[1:] & ~space[:-1])
            if len(edge):
                end += int(edge[0])
                seen = True
                break
            end += len(space) - 1
        yield at, (end if seen else n)
        at = end if seen else n


def _pieces(data: np.ndarray, offsets: np.ndarray) -> pa.Table:
    """The texts of a step, a row for each piece: of one long text several, of others one."""
    cuts = [(0, int(a), int(b)) for a, b in token_ends(data)] if is_long(offsets) else None
    if cuts is None:
        text = pa.Array.from_buffers(pa.large_string(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(data))])
        rows = np.arange(len(offsets) - 1, dtype=np.int64)
        return pa.table({"row": rows, "piece": np.zeros(len(rows), np.int64), "text": text})
    off = np.array([0, *(b for _, _, b in cuts)], np.int64)
    text = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data))])
    return pa.table({"row": np.zeros(len(cuts), np.int64), "piece": np.arange(len(cuts), dtype=np.int64), "text": text})


def _formatter(marks: tuple, seed: str, rate: int, spm: int):
    given = dict(zip("psm", marks, strict=True)) | {"seed": seed, "rate": rate, "spm": spm}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _session() as con:
            for batch in batches:
                data, offsets = text_bytes(valid(batch.column(2)))
                for a, b in steps(offsets, rows=ROWS):
                    con.register("ids", pa.table({"row": np.arange(b - a), "id": batch.column(1)[a:b]}))
                    con.register("pieces", _pieces(*sliced(data, offsets, a, b)))
                    out = con.sql(FORMAT, params=given).to_arrow_table().combine_chunks()
                    columns = [c.combine_chunks() for c in out.drop_columns(["row"]).cast(TABLE).columns]
                    yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], *columns], names=["id", *TABLE.names])

    return run


TABLE = pa.schema([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def fill_in_middle(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: str = "42", rate: int = 50, spm: int = 80, marks: tuple = MARKS) -> DataFrame:
    """A training text for each row of ``docs``, with its middle moved to the end in about ``rate`` of 100 rows.

    Returns the id, ``n`` (tokens), ``form``, ``prefix_chars`` and ``middle_chars``
    (code points; null for plain) and ``output``.  A text is cut at two places
    between tokens drawn from SHA-256 of seed and id; ``psm`` is prefix, suffix,
    middle, ``spm`` (``spm`` of 100 of the others) suffix, prefix, middle, each
    after its mark.  Other rows, empty texts and those that contain a mark are
    ``plain``: the text as it is.

    A null text is the empty text (n 0, plain, output empty); a null id draws as
    the empty id.  Rows that repeat give the same row again.  Bytes that aren't
    UTF-8 read as U+FFFD.  No table gives no rows, and other columns aren't read.  A text
    over 4 MB is cut in pieces; while it is at work, a task holds it some four times.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("shown"), F.col(text).alias("text"))
    made = rows.mapInArrow(_formatter(marks, seed, rate, spm), f"id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string")
    return made.withColumnRenamed("id", doc_id)


def _reader(marks: tuple, select: str, names: list[str]):
    given = dict(zip("psm", marks, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _session() as con:
            for batch in batches:
                _, offsets = text_bytes(batch.column("output"))
                for a, b in steps(offsets, rows=ROWS):
                    part = batch.slice(a, b - a)
                    con.register("made", pa.table({"row": np.arange(b - a), "form": part.column("form"), "output": part.column("output")}))
                    out = con.sql(f"SELECT {select} FROM ({RESTORED}) ORDER BY row", params=given).to_arrow_table()
                    columns = [c.cast(pa.string()).combine_chunks() for c in out.columns]
                    kept = [part.column(k) for k, c in enumerate(part.schema.names) if c != "output"]
                    yield pa.RecordBatch.from_arrays([*kept, *columns], names=[*(c for c in part.schema.names if c != "output"), *names])

    return run


def _read(made: DataFrame, marks: tuple, columns: dict[str, str]) -> DataFrame:
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields if f.name != "output")
    return made.mapInArrow(_reader(marks, ", ".join(columns.values()), list(columns)), f"{kept}, " + ", ".join(f"{c} string" for c in columns))


def restore(made: DataFrame, *, marks: tuple = MARKS) -> DataFrame:
    """What ``fill_in_middle`` made, with ``text``, read back from form and output alone, in place of ``output``."""
    return _read(made, marks, {"text": "restored"})


def digests(made: DataFrame, *, marks: tuple = MARKS) -> DataFrame:
    """What ``fill_in_middle`` made, with SHA-256 of the output and of the text restored from it in place of ``output``."""
    return _read(made, marks, {"output_sha256": "sha256(output)", "restored_sha256": "sha256(restored)"})
