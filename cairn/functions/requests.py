"""Checks of requests, as Columns that name what is wrong (null: nothing), and the rows that fail them."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import stripped, valid_path

#: How a commit may touch a path; of these, what must name the path before.
MOVES = ("renamed", "copied")
CHANGES = ("added", "modified", "deleted", *MOVES)


def first_of(*checks: Column) -> Column:
    """The first complaint of several checks."""
    return F.coalesce(*checks)


def path(value: Column) -> Column:
    return F.when(~F.coalesce(valid_path(value), F.lit(False)), "path_invalid")


def sha256(value: Column) -> Column:
    return F.when(~F.coalesce(value.rlike(r"^[0-9a-fA-F]{64}\z"), F.lit(False)), "sha256_invalid")


def git_sha(value: Column) -> Column:
    return F.when(~F.coalesce(value.rlike(r"^(?:[0-9a-fA-F]{40}|[0-9a-fA-F]{64})\z"), F.lit(False)), "commit_invalid")


def bounded(value: Column, least: int, most: int, name: str, zero_ok: bool = False) -> Column:
    """An optional number within bounds; null is the default and fine, as is 0 where it switches something off."""
    out = (value < least) | (value > most)
    return F.when(out & (value != 0) if zero_ok else out, name)


def top_k(value: Column, most: int) -> Column:
    return bounded(value, 1, most, "top_k_out_of_range")


def list_limit(value: Column, most: int) -> Column:
    return bounded(value, 1, most, "list_limit_out_of_range")


def code(value: Column, most_bytes: int) -> Column:
    return F.when(F.octet_length(F.coalesce(value, F.lit(""))) > most_bytes, "code_too_large")


def file_shape(sha: Column, retry_count: Column) -> Column:
    """What a stored file's row may not be: a hash that is no 64 hexadecimal characters, a negative counter."""
    return first_of(sha256(sha), F.when(retry_count < 0, "retry_count_negative"))


def chunk_shape(text: Column, start_line: Column, end_line: Column, start_column: Column, end_column: Column) -> Column:
    """A stored chunk has code, and a span of no negative place that does not end before the line it starts in."""
    empty = F.coalesce(F.length(text), F.lit(0)) == 0
    return F.when(empty | (F.least(start_line, end_line, start_column, end_column) < 0) | (start_line > end_line), "span_invalid")


def query(value: Column, most_bytes: int) -> Column:
    return F.when(F.coalesce(value, F.lit("")) == "", "query_empty").when(F.octet_length(value) > most_bytes, "query_too_long")


def budget(of: Column, caps: Mapping[str, int], floors: Mapping[str, int]) -> Column:
    """``of``: a struct of optional numbers. Those in ``caps`` only are 1 to their cap; those in ``floors`` too are their
    floor to their cap, and 0 switches them off unless their name ends in sections."""
    spend = [bounded(of[k], 1, cap, "budget_out_of_range") for k, cap in caps.items() if k not in floors]
    shape = [bounded(of[k], floor, caps[k], "shape_out_of_range", not k.endswith("sections")) for k, floor in floors.items()]
    return first_of(*spend, *shape)


def distinct_ids(ids: Column) -> Column:
    """The ids by first appearance, each once."""
    return F.array_distinct(ids)


def context_ids(ids: Column, most: int) -> Column:
    return F.when(F.size(distinct_ids(F.coalesce(ids, F.array().cast("array<string>")))) > most, "context_too_many")


def delete_ids(ids: Column, most: int) -> Column:
    n = F.size(distinct_ids(F.coalesce(ids, F.array().cast("array<string>"))))
    return F.when(n == 0, "selector_empty").when(n > most, "delete_too_many")


def entries(paths: Column, languages: Column) -> Column:
    """Patterns of a selector; absent lists have none."""
    return F.coalesce(F.array_size(paths), F.lit(0)) + F.coalesce(F.array_size(languages), F.lit(0))


def selector(paths: Column, languages: Column, most: int) -> Column:
    return F.when(entries(paths, languages) > most, "selector_too_large")


def some_selector(*n_entries: Column) -> Column:
    """What destroys must name something: the entries of include and of exclude."""
    total = F.lit(0)
    for n in n_entries:
        total = total + n
    return F.when(total == 0, "selector_empty")


def symbol(name: Column, limit: Column, most_bytes: int, most_results: int) -> Column:
    long = F.when(F.coalesce(name, F.lit("")) == "", "symbol_name_empty").when(F.octet_length(name) > most_bytes, "symbol_name_too_long")
    return first_of(long, bounded(limit, 1, most_results, "symbol_limit_out_of_range"))


def index_modes(symbols_only: Column, vectors_only: Column) -> Column:
    return F.when(symbols_only & vectors_only, "index_modes_exclusive")


def history_prune(keep_last: Column, older_than: Column) -> Column:
    return F.when(keep_last.isNull() & older_than.isNull(), "history_bound_missing")


def change(change_type: Column, path_: Column, old_path: Column) -> Column:
    """A path of a commit: a rename or a copy names where it came from, and nothing else does."""
    moved = change_type.isin(*MOVES)
    biconditional = F.when(moved & old_path.isNull(), "old_path_missing").when(~moved & old_path.isNotNull(), "old_path_unexpected")
    return first_of(path(path_), F.when(~F.coalesce(change_type.isin(*CHANGES), F.lit(False)), "change_type_invalid"), biconditional, F.when(moved, path(old_path)))


def commit(sha: Column, subject: Column, body: Column, paths: Column, most_bytes: int) -> Column:
    """``paths``: array of struct(path, change_type, old_path); the first that is wrong tells its complaint."""
    large = F.when(F.octet_length(subject) + F.octet_length(F.coalesce(body, F.lit(""))) > most_bytes, "message_too_large")
    wrong = F.get(F.array_compact(F.transform(paths, lambda p: change(p["change_type"], p["path"], p["old_path"]))), F.lit(0))
    return first_of(git_sha(sha), F.when(stripped(F.coalesce(subject, F.lit(""))) == "", "subject_empty"), large, wrong)


def rejects(rows: DataFrame, key: str, check: Column) -> DataFrame:
    """key, reason of the rows with a complaint."""
    return rows.select(key, check.alias("reason")).where("reason is not null")


def rejected_requests(entries_: DataFrame, request: str, check: Column, most: int, many: str = "too_many_files") -> DataFrame:
    """request, reason of requests of many entries (files of an index or drift body, commits of a history): ``many`` where
    there are more than ``most``, else the least complaint.

    Entries are counted and their complaints combined within tasks; no request is gathered.
    """
    by = entries_.select(request, check.alias("_why")).groupBy(request).agg(F.count(F.lit(1)).alias("_n"), F.min("_why").alias("_why"))
    return by.select(request, F.when(F.col("_n") > most, many).otherwise(F.col("_why")).alias("reason")).where("reason is not null")
