"""Entity linking and typing: paths, redirects, labels, types, anchors in text."""

from __future__ import annotations

import bisect

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import is_timestamp, timestamp_label
from ..functions.text import is_item, title_to_path
from ..session import stored
from ..sources.service import Service, dimension


def resolve_paths(rows: DataFrame, paths: DataFrame, redirects: DataFrame | Service, column: str = "path") -> DataFrame:
    """``rows`` with the id of each path: exact, else without dots, else that of its redirect; null if none.

    ``paths``: (path, id), ``redirects``: (from_path, to_title); of several ids or titles of a path the least
    counts. Distinct paths are resolved once, so ``rows`` are shuffled once whatever the dimensions' size. A service of
    redirects is asked for the paths that ``paths`` does not have, and no others.
    """
    ids = paths.groupBy("path").agg(F.min("id").alias("id"))
    exact = ids.select(F.col("path").alias("_p1"), F.col("id").alias("_id1"))
    dotless = ids.select(F.col("path").alias("_p2"), F.col("id").alias("_id2"))
    asked = rows.select(F.col(column).alias("_asked")).where("_asked is not null").distinct()
    found = asked.join(exact, F.col("_asked") == F.col("_p1"), "left").join(dotless, F.replace("_asked", F.lit("."), F.lit("")) == F.col("_p2"), "left")
    found = stored(found.select("_asked", F.coalesce("_id1", "_id2").alias("_id")), "paths")
    known = found.where("_id is not null").unionByName(_redirected(found.where("_id is null").select("_asked"), ids, redirects))
    return rows.join(known, F.col(column) == F.col("_asked"), "left").select(*rows.columns, F.col("_id").alias("id"))


def _redirected(candidates: DataFrame, ids: DataFrame, redirects: DataFrame | Service) -> DataFrame:
    """``(_asked, _id)`` of those paths ``_asked``, which the dictionary does not know, whose redirect it knows."""
    moved = dimension(redirects, candidates).groupBy(F.col("from_path").alias("_asked")).agg(title_to_path(F.min("to_title")).alias("_to"))
    return candidates.join(moved, "_asked").join(ids.select(F.col("path").alias("_to"), F.col("id").alias("_id")), "_to").select("_asked", "_id")


def label_of(item: Column, labels: Column) -> Column:
    """A timestamp's date, else the first label that is no id, else the first label, else the id."""
    named = F.filter(labels, lambda x: ~is_item(x))
    return F.when(is_timestamp(item), timestamp_label(item)).otherwise(F.coalesce(F.get(named, F.lit(0)), F.get(labels, F.lit(0)), item))


def _same(column: str) -> Column:
    """The join of ``column`` with a dimension's ``_id``: by a hash as well, by which rows are sorted without a look at the ids, many of which begin alike."""
    return (F.xxhash64(column) == F.xxhash64("_id")) & (F.col(column) == F.col("_id"))


def with_labels(rows: DataFrame, labels: DataFrame | Service, column: str = "id") -> DataFrame:
    named = dimension(labels, rows.select(column)).select(F.col("id").alias("_id"), "labels")
    return rows.join(named, _same(column), "left").withColumn("label", label_of(F.col(column), F.col("labels"))).drop("_id", "labels")


def with_types(rows: DataFrame, entities: DataFrame | Service, column: str = "id") -> DataFrame:
    """``rows`` with each id's type, "NULL" if unknown, and the sum of its frequencies."""
    dim = dimension(entities, rows.select(column)).select(F.col("id").alias("_id"), F.col("type").alias("_t"), F.aggregate(F.coalesce("frequency", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("_f"))
    return rows.join(dim, _same(column), "left").select(*rows.columns, F.coalesce("_t", F.lit("NULL")).alias("type"), F.coalesce("_f", F.lit(0)).alias("frequency"))


def with_all_types(rows: DataFrame, entities: DataFrame | Service, column: str = "id") -> DataFrame:
    """``rows`` whose id has types, with all of them by label (``types``) and the sum of its frequencies."""
    labels = F.array_distinct(F.filter(F.transform("types", lambda t: t["label"]), lambda t: t.isNotNull()))
    total = F.aggregate(F.coalesce("frequency", F.array().cast("array<bigint>")), F.lit(0).cast("bigint"), lambda a, x: a + x)
    dim = dimension(entities, rows.select(column)).select(F.col("id").alias("_id"), labels.alias("_types"), total.alias("_f")).where(F.size("_types") > 0)
    return rows.join(dim, F.col(column) == F.col("_id")).select(*rows.columns, F.col("_types").alias("types"), F.col("_f").alias("frequency"))


def link_anchors(text: Column, anchors: Column) -> Column:
    """Anchors ``array<struct<text, path>>`` that a text holds: ``array<struct<text, path, s, e>>``.

    Longest first, ties in order; only an anchor's first occurrence counts, targets with "#" do not, and
    one that begins or ends in a place already taken (ends included) is left out.
    """
    numbered = F.transform(F.filter(anchors, lambda a: ~F.contains(a["path"], F.lit("#")) & (a["text"] != "")), lambda a, i: F.struct((-F.length(a["text"])).alias("n"), i.alias("i"), a["text"].alias("text"), a["path"].alias("path")))
    placed = F.transform(F.array_sort(numbered), lambda a: F.struct(a["text"].alias("text"), a["path"].alias("path"), (F.position(a["text"], text) - 1).alias("s"), (F.position(a["text"], text) - 1 + F.length(a["text"])).alias("e")))
    start = F.array().cast("array<struct<text:string,path:string,s:int,e:int>>")

    def taken(acc: Column, a: Column) -> Column:
        return F.exists(acc, lambda b: a["s"].between(b["s"], b["e"]) | a["e"].between(b["s"], b["e"]))

    return F.aggregate(placed, start, lambda acc, a: F.when(F.coalesce(a["s"] < 0, F.lit(True)) | taken(acc, a), acc).otherwise(F.concat(acc, F.array(a))))


LINKS = "array<struct<text:string,path:string,s:int,e:int>>"
ROW = pa.list_(pa.struct([("text", pa.string()), ("path", pa.string()), ("s", pa.int32()), ("e", pa.int32())]))


class _Automaton:
    """A page's anchors, found in a text in one pass over it."""

    def __init__(self, anchors: list[tuple[str, str]]) -> None:
        self.anchors = [(t, p) for t, p in anchors if t and p is not None and "#" not in p]
        self.order = sorted(range(len(self.anchors)), key=lambda i: (-len(self.anchors[i][0]), i))
        self.found = None
        if self.anchors:
            self.found = ahocorasick.Automaton()
            for text, _ in self.anchors:
                self.found.add_word(text, text)
            self.found.make_automaton()

    def links(self, text: str | None) -> list[tuple[str, str, int, int]]:
        """As ``link_anchors``: an anchor is never longer than those placed before it, so only its neighbours by place can hold one of its ends."""
        if not text or self.found is None:
            return []
        first: dict[str, int] = {}
        for end, word in self.found.iter(text):
            first.setdefault(word, end + 1 - len(word))
        starts: list[int] = []
        placed: dict[int, tuple[str, str, int, int]] = {}
        out = []
        for i in self.order:
            word, path = self.anchors[i]
            if (s := first.get(word)) is None:
                continue
            e = s + len(word)
            at = bisect.bisect_right(starts, e)
            if at and placed[starts[at - 1]][3] >= s:
                continue
            starts.insert(at, s)
            placed[s] = (word, path, s, e)
            out.append(placed[s])
        return out


def linked_texts(rows: DataFrame, anchors: DataFrame, key: str, number: str, text: str = "text") -> DataFrame:
    """``(key, number, links)`` of ``rows(key, number, text)`` by the anchors ``(key, pos, text, path)`` of the same key, as ``link_anchors`` has them.

    Rows meet their page's anchors in one place, sorted behind them, where an automaton of all of them reads each text once; anchors are
    copied to no row, and a task holds the anchors of one page. Rows without anchors, null and empty texts have no links.
    """

    t = rows.schema
    left = rows.select(F.col(key).alias("_k"), F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_pos"), F.col(number).alias("_n"), F.col(text).alias("_text"), F.lit(None).cast("string").alias("_path"))
    right = anchors.where("text is not null").select(F.col(key).alias("_k"), F.lit(0).alias("_side"), F.col("pos").cast("long").alias("_pos"), F.lit(None).cast(t[number].dataType).alias("_n"), F.col("text").alias("_text"), F.col("path").alias("_path"))

    def run(batches):
        """Pages one after the other, a page's anchors before its texts: no page costs a call of its own."""
        page, known, automaton = object(), [], None
        for batch in batches:
            at, links = [], []
            for i, (k, side, word, path) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("_k", "_side", "_text", "_path")))):
                if k != page:
                    page, known, automaton = k, [], None
                if side == 0:
                    known.append((word, path))
                    continue
                if automaton is None:
                    automaton = _Automaton(known)
                at.append(i)
                links.append([dict(zip(("text", "path", "s", "e"), x)) for x in automaton.links(word)])
            own = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column("_k"), own.column("_n"), pa.array(links, ROW)], names=[key, number, "links"])

    both = left.unionByName(right).repartition("_k").sortWithinPartitions("_k", "_side", F.col("_pos").asc_nulls_last())
    return both.mapInArrow(run, f"`{key}` {t[key].dataType.simpleString()}, `{number}` {t[number].dataType.simpleString()}, links {LINKS}")


def reconciled(rows: DataFrame, names: DataFrame, column: str = "url") -> DataFrame:
    """``rows`` with the first hit ``(id, name)`` of their URL in ``names(url, rank, id, name)``; null without one."""
    first = names.groupBy(F.col("url").alias("_u")).agg(F.min(F.struct("rank", "id", "name")).alias("_n"))
    return rows.join(first, F.col(column) == F.col("_u"), "left").select(*rows.columns, F.col("_n.id").alias("id"), F.col("_n.name").alias("name"))


def titled(title: Column, sentence: Column) -> Column:
    from ..functions.text import one_line

    return one_line(F.concat_ws(", ", title, sentence))
