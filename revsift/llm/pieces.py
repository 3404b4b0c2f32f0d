"""Long texts cut into overlapping pieces at natural boundaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revsift.functions.text import bound
from revsift.operators.snapshots import current_rows

LIMIT, OVERLAP = 2000, 200


def boundary_pattern(most: int) -> str:
    """Takes up to `most` characters, up to the end of the text or the strongest boundary there is.

    In order: before a definition or a blank line in the last third, after a line in the last half, after a statement there,
    else after any line, any statement, at a blank in the last half, at any character. So a line that is short before a very
    long one is a step of its own only where nothing in reach is nearer to the limit. All quantifiers are bounded and stand on single characters, so matching never nests.
    """
    third, half = most * 2 // 3, most // 2
    end = r"(?:\r\n|\r(?!\n)|\n)"  # \R could match the first half of a line end
    return (
        rf"(?s).{{1,{most}}}\z"
        rf"|.{{{third},{most - 2}}}{end}(?=[ \t]*(?:@\w|(?:async[ \t]+)?def\s|class\s))"
        rf"|.{{{third},{most - 2}}}{end}(?=[ \t]*{end})"
        rf"|.{{{half},{most - 2}}}{end}"
        rf"|.{{{half},{most - 2}}};[ \t]?"
        rf"|.{{0,{most - 2}}}{end}"
        rf"|.{{0,{most - 2}}};[ \t]?"
        rf"|.{{{half},{most - 1}}}\s"
        rf"|.{{1,{most}}}"
    )


def cut_pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """The pieces of a text: each has at most `limit` characters and begins with the last `overlap` of what is before it.

    Characters are code points. The overlap is mostly in the two steps before; where these are shorter, so many steps as it has
    characters are looked back over, as none is empty. Without the first `overlap` characters of all but the first, the pieces make up the text.
    """
    if not 0 <= overlap * 4 <= limit or limit - overlap < 16:
        raise ValueError("the overlap must be at most a quarter of the limit")
    steps = F.regexp_extract_all(text, F.lit(boundary_pattern(limit - overlap)), F.lit(0))
    if not overlap:
        return steps

    def joined(x: Column) -> Column:
        def before(i: Column) -> Column:
            two = F.concat(F.coalesce(F.get(x, i - 2), F.lit("")), F.get(x, i - 1))
            more = F.array_join(F.slice(x, F.greatest(i - overlap, F.lit(0)) + 1, F.least(i, F.lit(overlap))), "")
            return F.right(F.when((F.length(two) < overlap) & (i > 2), more).otherwise(two), F.lit(overlap))

        return F.transform(x, lambda s, i: F.when(i == 0, s).otherwise(F.concat(before(i), s)))

    return bound(steps, joined)


def split_oversized(rows: DataFrame, keys: list[str], text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, piece_no from 0, piece) of every row whose text is longer than limit; other rows, also null ones, give none.

    No row's pieces depend on another row, so nothing is shuffled; a text is cut within one task, in time linear in it.
    Repeated rows give repeated pieces; the caller picks its current rows first. Other columns are ignored.
    """
    long = rows.select(*keys, F.col(text).alias("_text")).where(F.length("_text") > limit)
    long = long.select(*keys, cut_pieces(F.col("_text"), limit, overlap).alias("_pieces"))
    return long.select(*keys, F.posexplode("_pieces").alias("piece_no", "piece"))


def oversized_sources(entities: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """split_oversized for the current rows of entities. Only texts above the limit are moved; null keys are dropped."""
    text = F.when(F.length("source_code") > limit, F.col("source_code"))
    rows = entities.where("commit_hash is not null and entity_id is not null").select("commit_hash", "entity_id", "ingested_at", text.alias("source_code"))
    return split_oversized(current_rows(rows, ["commit_hash", "entity_id"], "ingested_at", ["source_code"]), ["commit_hash", "entity_id"], "source_code", limit, overlap)
