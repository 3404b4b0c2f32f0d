"""Text as columns: normal forms, identifiers, word n-grams, leaks of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def collapse(text: Column) -> Column:
    """Single blanks, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def lower_collapse(text: Column) -> Column:
    return F.lower(collapse(text))


def commit_key(value: Column) -> Column:
    """What a spelling of a commit is known by: the first 8 hexadecimal digits in lower case; null if it names no commit.

    A commit is named by 8 to 40 hexadecimal digits, white space around them aside. Zeros alone are Git's null id, which
    stands for "no commit".
    """
    v = F.lower(F.regexp_replace(value, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    return F.when(v.rlike(r"\A(?!0+\z)[0-9a-f]{8,40}\z"), F.substring(v, 1, 8))


def split_identifier(name: Column) -> Column:
    """camelCase and snake_case as an array of words in lower case; other characters stay where they are."""
    x = F.regexp_replace(F.regexp_replace(name, "(.)([A-Z][a-z]+)", "$1 $2"), "([a-z0-9])([A-Z])", "$1 $2")
    return F.array_remove(F.split(F.translate(F.lower(x), "_", " "), r"\s+"), "")


def bound(value: Column, body) -> Column:
    """body(value), an array, with value computed once: within a lambda an expression would be computed for every element."""
    return F.flatten(F.transform(F.array(value), body))


def ngrams(text: Column, n: int = 4) -> Column:
    """Distinct runs of n words of a-z and 0-9, in lower case."""
    words = F.array_remove(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), "")

    def runs(w: Column) -> Column:
        all_ = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
        return F.when(F.size(w) >= n, F.array_distinct(all_)).otherwise(F.array().cast("array<string>"))

    return bound(F.coalesce(words, F.array().cast("array<string>")), runs)


def shared_ngrams(text: Column, source: Column, n: int = 4) -> Column:
    """Word n-grams that two texts have in common, sorted; empty where one is null."""
    return F.array_sort(F.array_intersect(ngrams(text, n), ngrams(source, n)))


def forbidden_terms(entity_id: Column, file_path: Column) -> Column:
    """Terms that give an entity away: each name of its path (file aside), its own name's words of 4 letters or more, its
    file and the file's stem; in lower case, without terms of underscores only."""
    parts = F.split(entity_id, "::")
    names = F.when(F.size(parts) > 1, F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).otherwise(parts)
    file = F.regexp_extract(F.coalesce(file_path, F.lit("")), r"([^/]*)/*$", 1)
    stem = F.when(file.rlike(r"^.+\.[^.]*$"), F.regexp_replace(file, r"\.[^.]*$", "")).otherwise(file)
    words = F.filter(split_identifier(F.element_at(parts, -1)), lambda w: F.length(w) >= 4)
    none = F.array().cast("array<string>")
    files = F.when(file != "", F.concat(F.array(file), F.when((F.length(stem) >= 4) & (stem != "__init__"), F.array(stem)).otherwise(none))).otherwise(none)
    return F.array_sort(F.array_distinct(F.transform(F.filter(F.concat(names, words, files), lambda t: F.translate(t, "_", "") != ""), F.lower)))


def leaked_terms(text: Column, entity_id: Column, file_path: Column) -> Column:
    """Forbidden terms that occur in a text as whole words of a-z, 0-9 and _, and the whole path wherever it occurs; sorted."""
    low, path = F.lower(text), F.lower(file_path)
    # a term's neighbours decide, so every place is tried by cutting the text at the term
    def within(t: Column) -> Column:
        parts = F.split(low, F.concat(F.lit(r"\Q"), t, F.lit(r"\E")), -1)
        ends = F.transform(F.sequence(F.lit(0), F.greatest(F.size(parts) - 2, F.lit(0))), lambda i: ~F.get(parts, i).rlike("[a-z0-9_]$") & ~F.coalesce(F.get(parts, i + 1), F.lit("a")).rlike("^[a-z0-9_]"))
        return (F.size(parts) > 1) & F.exists(ends, lambda e: e)

    whole = F.when((F.length(path) > 0) & F.contains(low, path), F.array(path)).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(F.filter(forbidden_terms(entity_id, file_path), within), whole)))


def violations(text: Column, entity_id: Column, file_path: Column, source: Column) -> Column:
    """What is wrong with a query for an entity: identifier:<leaked terms> and verbatim:<first 4-gram copied from its source>."""
    leaked, copied = leaked_terms(text, entity_id, file_path), shared_ngrams(text, source)
    return F.array_compact(F.array(F.when(F.size(leaked) > 0, F.concat(F.lit("identifier:"), F.array_join(leaked, ","))), F.when(F.size(copied) > 0, F.concat(F.lit("verbatim:"), copied[0]))))


def docstring_summary(source: Column) -> Column:
    """The first line of the first string in three double (else single) quotes, if it has more than 5 characters."""

    def of(q: str) -> Column:
        line = F.split(F.trim(F.regexp_extract(source, f"(?s){q}\\s*(.*?){q}", 1)), "\n")[0]
        return F.when(source.rlike(f"(?s){q}.*?{q}"), F.trim(F.regexp_replace(line, r"^\s+|\s+$", "")))

    found = F.coalesce(of('"{3}'), of("'{3}"))
    return F.when(F.length(found) > 5, found)


def run_id(version: Column, seed: Column, before: Column, after: Column) -> Column:
    return F.format_string("benchmark_v%s_seed%s_%s_%s", version.cast("string"), seed.cast("string"), F.substring(before, 1, 8), F.substring(after, 1, 8))


def cleaned(source: Column) -> Column:
    """A source without strings in three quotes and without comments; a # in a string of one line stays."""
    bare = F.regexp_replace(source, r"""(?s)\"{3}.*?\"{3}|'{3}.*?'{3}""", "")
    return F.regexp_replace(bare, r"""(?m)("[^"\n]*"|'[^'\n]*')|#[^\n]*""", "$1")
