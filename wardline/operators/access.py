"""What the service's screens and stores need of records: scopes, searches, pages of merges and histories, batches, sealed values."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BATCH = 100
MARK = "\n\n---JSON---\n"
#: What sealed values start with, and how long keys are.
SEALED, KEY_BYTES = b"WLS1", 32


def scope(df: DataFrame, record_ids: list[int] | None = None, record_types: list[str] | None = None, category: str | None = None, date_from=None, date_to=None) -> DataFrame:
    """Rows of one choice, ids before types before a category (``full`` is none), and of days from and to, both included."""
    if record_ids:
        df = df.filter(F.col("id").isin(*record_ids))
    elif record_types:
        df = df.filter(F.col("record_type").isin(*record_types))
    elif category and category != "full":
        df = df.filter(F.col("record_type") == category)
    for limit, op in ((date_from, "__ge__"), (date_to, "__le__")):
        if limit is not None:
            df = df.filter(getattr(F.col("effective_date"), op)(F.lit(limit)))
    return df


def table_search(df: DataFrame, text: str, columns: list[str], record_type: str | None = None) -> DataFrame:
    """Rows whose ``columns``, one after the other, hold a text whatever its case."""
    found = F.contains(F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])), F.lit(text.lower()))
    return df.filter(found & (F.col("record_type") == record_type if record_type else F.lit(True)))


def real_value(value: Column, name: Column) -> Column:
    """Whether a value is there and says more than its name."""
    return F.coalesce((F.trim(value) != "") & ~F.trim(value).eqNullSafe(name), F.lit(False))


def compact() -> Column:
    """The five fields a merge shows of a record."""
    return F.struct("id", "display_text", "record_type", "source_format", "effective_date")


def category_label(section: Column, category: Column) -> Column:
    return F.coalesce(F.nullif(section, F.lit("")), F.get(category, F.lit(0)))


def visible_candidates(candidates: DataFrame, records: DataFrame) -> DataFrame:
    """Candidates whose first record is among ``records``, those a user may see."""
    return candidates.join(records.select(F.col("id").alias("id_a")), "id_a", "left_semi")


def merges_page(candidates: DataFrame, records: DataFrame, search: str | None = None, record_type: str | None = None, source: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """A page per user of merged candidates with both records, the last resolved first, and counts of the automatic and manual ones.

    ``search`` is looked for in the texts of both; ``source`` (auto, manual)
    chooses what is listed, not what is counted.
    """
    side = lambda n: records.select(F.col("id").alias(f"id_{n}"), F.col("display_text").alias(f"text_{n}"), *([F.col("user_id"), F.col("record_type")] if n == "a" else []))
    rows = candidates.filter("status = 'merged'").select("candidate_id", "id_a", "id_b", "auto_resolved", "resolved_at").join(side("a"), "id_a").join(side("b"), "id_b")
    if record_type:
        rows = rows.filter(F.col("record_type") == record_type)
    if search:
        rows = rows.filter(F.col("text_a").ilike(f"%{search}%") | F.col("text_b").ilike(f"%{search}%"))
    listed = F.lit(True) if source is None else F.col("auto_resolved") == (source == "auto")
    counts = rows.groupBy("user_id").agg(F.count_if("auto_resolved").alias("n_auto"), F.count_if(~F.col("auto_resolved")).alias("n_manual"))
    order = Window.partitionBy("user_id").orderBy(F.desc_nulls_last("resolved_at"), "candidate_id")
    placed = rows.filter(listed).withColumn("place", F.row_number().over(order).cast("long")).filter((F.col("place") > (page - 1) * size) & (F.col("place") <= page * size))
    return placed.join(counts, "user_id")


def history(df: DataFrame, owner: str, at: str, key: str, pending: Column | None = None, size: int = 50) -> DataFrame:
    """The newest rows of an owner (of ``pending`` ones if given), with their place."""
    rows = df if pending is None else df.filter(pending)
    order = Window.partitionBy(owner).orderBy(F.desc_nulls_last(at), key)
    return rows.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= size)


def batches(candidates: DataFrame, upload: str, key: str, size: int = BATCH) -> DataFrame:
    """``candidates`` with the number of the batch each is saved in, counted per upload."""
    order = Window.partitionBy(upload).orderBy(key)
    return candidates.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("int"))


def _whole_key(key: Column) -> Column:
    return F.when(F.octet_length(key) == KEY_BYTES, key).otherwise(F.raise_error(F.lit(f"a key has {KEY_BYTES} bytes")).cast("binary"))


def seal(value: Column, key: Column, about: Column | None = None) -> Column:
    """AES-256-GCM of a value under a mark, with a random start, so equal values differ; ``about`` is vouched for and not kept."""
    args = (F.lit("GCM"), F.lit("DEFAULT")) + ((F.lit(b""), about) if about is not None else ())
    return F.concat(F.lit(SEALED), F.aes_encrypt(value, _whole_key(key), *args))


def unseal(sealed: Column, key: Column, about: Column | None = None) -> Column:
    """The value again. What has no mark was never sealed and passes as it is; a changed value, another key or another ``about`` is an error."""
    args = (F.lit("GCM"), F.lit("DEFAULT")) + ((about,) if about is not None else ())
    body = F.substr(sealed, F.lit(len(SEALED) + 1))
    return F.when(F.startswith(sealed, F.lit(SEALED)), F.aes_decrypt(body, _whole_key(key), *args)).otherwise(sealed)


def hmac_sha256(value: Column, key: bytes) -> Column:
    """HMAC-SHA256 of a binary value as lower-case hex."""
    block = (key if len(key) <= 64 else hashlib.sha256(key).digest()).ljust(64, b"\0")
    inner, outer = (bytes(b ^ pad for b in block) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(F.lit(outer), F.unhex(F.sha2(F.concat(F.lit(inner), value), 256))), 256)


def blind_index(value: Column, key: bytes) -> Column:
    """A keyed digest to look a sealed value up by: equal for equal values in any case and spacing around."""
    return hmac_sha256(F.encode(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), "utf-8"), key)


def summary_text(said: Column, data: Column) -> Column:
    """What is stored of a summary: its text, then its JSON under a mark; either may be missing."""
    some = lambda x: F.nullif(x, F.lit(""))
    return F.concat_ws(MARK, some(said), some(data))


def read_summary(stored: Column) -> Column:
    """struct(said, data) of a stored summary; JSON alone is data."""
    at = F.locate(MARK, stored)
    alone = F.substring(stored, 1, 1) == "{"
    said = F.when(at > 0, F.left(stored, at - 1)).when(~alone, stored)
    data = F.when(at > 0, F.substr(stored, at + F.lit(len(MARK)))).when(alone, stored)
    return F.struct(said.alias("said"), data.alias("data"))


def basket(items: DataFrame, records: DataFrame) -> DataFrame:
    """A user's chosen records, the last chosen first; deleted ones stay listed."""
    order = Window.partitionBy("user_id").orderBy(F.desc("chosen_at"), "record_id")
    joined = items.join(records.select(F.col("id").alias("record_id"), "display_text", "record_type"), "record_id")
    return joined.withColumn("place", F.row_number().over(order).cast("long"))


def engines(chosen: Column, cloud: Column, results: Column) -> Column:
    """Engines tried for a page, in order: the chosen one, and after a local one that did not do it one other, never after a cloud one.

    ``results`` maps an engine to ok, refused or error; ``cloud`` lists those
    that send data out.
    """
    outcome = F.coalesce(F.try_element_at(results, chosen), F.lit("error"))
    others = F.array_sort(F.filter(F.map_keys(results), lambda e: (e != chosen) & ~F.array_contains(cloud, e)))
    again = (outcome != "ok") & ~F.array_contains(cloud, chosen)
    return F.when(again, F.concat(F.array(chosen), F.slice(others, 1, 1))).otherwise(F.array(chosen))
