"""Column functions for text: tokens, token estimates, lines, slugs, identifiers and pointers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Letters, digits and underscore of any script; plain \\w is ASCII only on the JVM.
WORD = r"[\p{L}\p{N}_]+"
_NON_ASCII = r"[^\x00-\x7F]"
# The ranges of the scripts that take about 1.5 characters a token.
_DENSE = r"[⺀-鿿぀-ヿ가-힯豈-﫿]"


def tokens(text: Column) -> Column:
    """Lower-cased words in order; empty for null."""
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0), F.lower)


def token_estimate(text: Column) -> Column:
    """About how many tokens a text costs: 4 ASCII characters each, 2.2 of other alphabets, 1.5 of the dense scripts; at least 1."""
    text = F.coalesce(text, F.lit(""))
    other = F.regexp_count(text, F.lit(_NON_ASCII))
    dense = F.regexp_count(text, F.lit(_DENSE))
    plain = F.length(text) - other
    mixed = plain / 4.0 + (other - dense) / 2.2 + dense / 1.5
    return F.greatest(F.lit(1), F.when(other == 0, F.floor(plain / 4)).otherwise(F.floor(mixed)).cast("int"))


def id_tail(ident: Column) -> Column:
    """The part of a node id after its category."""
    return F.regexp_replace(ident, r"^[^:]*:", "")


def search_text(ident: Column, summary: Column, part_of: Column, tags: Column, body: Column) -> Column:
    """The bag of words a node is found by: its id spelled out, summary, topics, tags and the first 600 characters of its body."""
    spelled = F.regexp_replace(F.regexp_replace(id_tail(ident), "::|/|_", " "), " +", " ")
    topics = F.array_join(F.coalesce(F.transform(part_of, lambda p: F.coalesce(p["topic"], F.lit(""))), F.array().cast("array<string>")), " ")
    return F.concat_ws(" ", spelled, F.coalesce(summary, F.lit("")), topics, F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " "), F.substring(F.coalesce(body, F.lit("")), 1, 600))


def slug(text: Column, longest: int = 48) -> Column:
    """Lower-case words joined by hyphens."""
    words = F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"[^\p{L}\p{N}_\s-]", ""), r"[\s_-]+", "-")
    return F.substring(F.regexp_replace(words, "^-+|-+$", ""), 1, longest)


def code_pointer(path: Column, first: Column, last: Column) -> Column:
    """path:line, or path:first-last where the last line is known and another."""
    return F.when((last.isNotNull()) & (first.isNotNull()) & (last != first) & (last != 0) & (first != 0), F.format_string("%s:%d-%d", path, first, last)).otherwise(F.concat(path, F.lit(":"), F.coalesce(first.cast("string"), F.lit("None"))))


def subtree(path: Column, depth: int = 1) -> Column:
    """The first ``depth`` directories of a path, ``_root`` where it has none."""
    parts = F.split(path, "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    return F.when(F.size(parts) > 1, F.array_join(F.slice(dirs, 1, depth), "/")).otherwise(F.lit("_root"))
