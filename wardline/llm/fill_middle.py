"""Fill-in-the-middle transformation by an Aho-Corasick event scan.

One automaton holds the ASCII characters at which a unit can end and the
sentinels; one pass over a text yields its events. Between events nothing can
change, so the number of units and the place where the k-th ends follow from
the events alone: a cut is a look-up by rank in that sparse list.

Units: ``line`` is ``[^\\n]*\\n|[^\\n]+``, ``word`` is a run of non-blanks with
the ASCII blanks after it (blanks before the first word are a unit), ``char``
is a code point, whose rank is its place.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import bounded
from wardline.session import spread, table

#: Starts of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
SEED, RATE, SPM_RATE = 7, 100, 50
#: Characters at which a unit can end.
ENDS = {"line": "\n", "word": " \t\n\x0b\x0c\r", "char": ""}
#: Texts and what becomes of them leave a task once so many code points are together.
FLUSH = 2_000_000


def automaton(unit: str, sentinels: tuple[str, str, str] = SENTINELS) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for c in ENDS[unit]:
        found.add_word(c, 0)
    for s in sentinels:
        found.add_word(s, 1)
    found.make_automaton()
    return found


def unit_ends(scan: ahocorasick.Automaton, text: str, unit: str) -> tuple[list[int] | range, bool]:
    """Where each unit ends (``char``: a range, nothing is listed), and whether a sentinel occurs."""
    ends, marked = [], False
    for at, kind in scan.iter(text):
        if kind:
            marked = True
        elif unit == "word" and ends and ends[-1] == at:
            ends[-1] = at + 1  # a run of blanks ends one unit
        else:
            ends.append(at + 1)
    if unit == "char":
        return range(1, len(text) + 1), marked
    if len(text) > (ends[-1] if ends else 0):
        ends.append(len(text))
    return ends, marked


def split_text(scan: ahocorasick.Automaton, text: str, draws: tuple[int, int, int, int], unit: str, sentinels: tuple[str, str, str], rate: int, spm_rate: int) -> tuple[int, str, int | None, int | None, str]:
    """n, form, code points of prefix and middle, output."""
    ends, marked = unit_ends(scan, text, unit)
    n = len(ends)
    if not text or marked or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    p, s, m = sentinels
    if draws[3] % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"
    return n, "psm", a, b - a, f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def _run(unit: str, sentinels: tuple[str, str, str], rate: int, spm_rate: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = automaton(unit, sentinels)
        for batch in batches:
            ids, texts, *draws = batch.columns
            rows, held = [], 0
            for i in range(batch.num_rows):
                row = split_text(scan, texts[i].as_py(), tuple(d[i].as_py() for d in draws), unit, sentinels, rate, spm_rate)
                rows.append((ids[i].as_py(), *row))
                held += len(row[-1])
                if held > FLUSH or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)
                    rows, held = [], 0

    return run


def fill_in_middle(docs: DataFrame, unit: str = "line", sentinels: tuple[str, str, str] = SENTINELS, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n (units), form, prefix_chars, middle_chars, output.

    Cuts and form are drawn from the sha256 of seed and doc_id, so a run can be
    repeated; rows without doc_id draw as if it were empty. Null texts count as
    empty; empty texts and those that hold a sentinel stay as they are (form
    plain, null sizes). Very long texts are cut as a whole. Repeated rows are
    cut alike; cuts that tie leave an empty middle. Empty table: no rows. Other
    columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draw = [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = bounded(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *draw)
    return rows.mapInArrow(_run(unit, sentinels, rate, spm_rate), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output was made of."""
    parts = F.split(output, "|".join(rf"\Q{s}\E" for s in sentinels))
    get = lambda i: F.get(parts, F.lit(i))
    return F.when(form == "psm", F.concat(get(1), get(3), get(2))).when(form == "spm", F.concat(get(2), get(3), get(1))).otherwise(output)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLE_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), counted AS (
  SELECT *, string_split(text, chr(10)) AS parts, length(text) - length(replace(text, chr(10), '')) + CAST(text <> '' AND NOT ends_with(text, chr(10)) AS BIGINT) AS n,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM drawn
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS low, greatest(h1 % (n + 1), h2 % (n + 1)) AS high,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM counted
), cut AS (
  SELECT *, CASE WHEN low = n THEN text WHEN low = 0 THEN '' ELSE array_to_string(parts[1:low], chr(10)) || chr(10) END AS prefix,
    CASE WHEN high = n THEN text WHEN high = 0 THEN '' ELSE array_to_string(parts[1:high], chr(10)) || chr(10) END AS upto FROM formed
), laid AS (
  SELECT doc_id, n, form, text, prefix, text[length(prefix) + 1 : length(upto)] AS middle, text[length(upto) + 1 :] AS suffix FROM cut
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE text END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM laid
"""
