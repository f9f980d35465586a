"""Organising generated records: duplicates, folding of children into collections, cross-level collisions, chapters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import text as T
from ..functions.keys import folded
from ..sources.sinks import written
from .material import KINDS, collisions

BULLET = "struct<title:string,original:string,recitation:string,keywords:string,chunk_ids:array<string>,pages:array<bigint>>"
RECORD = f"project string, chapter string, record long, title string, item string, parent_item string, bullets array<{BULLET}>, candidates array<string>"
COLUMNS = ["project", "chapter", "record", "title", "item", "parent_item", "bullets", "candidates"]
_TERM, _BLANKS = re.compile(C.TERM), re.compile("\\s+")
_KEYWORDS, _PARAGRAPHS = re.compile(C.KEYWORD_SPLIT), re.compile(C.PARAGRAPHS)


def title_keys(records: DataFrame) -> DataFrame:
    """records with the title keys that folding compares: JVM-side, so that the fold itself needs no text rules."""
    return records.select(
        "*", T.title_key(F.col("title")).alias("title_key"), T.title_key(F.col("item")).alias("item_key"), T.title_key(F.coalesce("parent_item", F.lit(""))).alias("parent_key"),
        F.transform("bullets", lambda b: T.title_key(b["title"])).alias("bullet_keys"), (F.col("title").rlike(C.COLLECTION_RECORD) | F.col("item").rlike(C.COLLECTION_RECORD)).alias("collects"),
    )


def deduplicate_records(records: DataFrame) -> DataFrame:
    """One record for each chapter and title key: the first one's texts, bullets united by title key, candidates united."""
    k = title_keys(records)
    place = F.struct("record")
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("record", F.col(c).alias("v")))), lambda x: x["v"])
    merged = k.groupBy("project", "chapter", "title_key").agg(
        F.min("record").alias("record"), F.min_by("title", place).alias("title"), F.min_by("item", place).alias("item"), F.min_by("parent_item", F.when(F.col("parent_item").isNotNull(), F.col("record"))).alias("parent_item"),
        F.flatten(ordered("bullets")).alias("all_bullets"), F.flatten(ordered("bullet_keys")).alias("all_keys"), F.array_distinct(F.flatten(ordered("candidates"))).alias("candidates"),
    )
    keyed = F.arrays_zip(F.col("all_keys").alias("k"), F.col("all_bullets").alias("b"))
    first = F.filter(F.col("keyed"), lambda x, i: F.array_position(F.col("all_keys"), x["k"]) == i + 1)

    def united(x):
        same = F.filter(F.col("keyed"), lambda y: y["k"] == x["k"])
        texts = [x["b"][c].alias(c) for c in ("title", *KINDS)]
        ids, pages = F.transform(same, lambda y: y["b"]["chunk_ids"]), F.transform(same, lambda y: y["b"]["pages"])
        return F.struct(*texts, F.array_distinct(F.flatten(ids)).alias("chunk_ids"), F.array_sort(F.array_distinct(F.flatten(pages))).alias("pages"))

    return merged.withColumn("keyed", keyed).withColumn("bullets", F.transform(first, united)).select(*COLUMNS)


def fold_children(records: DataFrame) -> DataFrame:
    """Later records of a chapter become bullets of a collection that names them as parent, or whose bullet has their
    title and which shares at least half of the candidates.  A parent changes as it takes children, so a chapter's
    records (a chapter of one project, tens of rows) are folded in order in one group."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = [dict(r._asdict()) | {"bullets": [dict(b) for b in r.bullets], "bullet_keys": list(r.bullet_keys), "candidates": list(r.candidates)} for r in group.sort_values("record").itertuples(index=False)]
        gone: set[int] = set()
        for i, parent in enumerate(rows):
            if i in gone or not parent["collects"]:
                continue
            for j in range(i + 1, len(rows)):
                child = rows[j]
                if j in gone:
                    continue
                at = parent["bullet_keys"].index(child["title_key"]) if child["title_key"] in parent["bullet_keys"] else None
                shared, least = len(set(parent["candidates"]) & set(child["candidates"])), min(len(set(parent["candidates"])), len(set(child["candidates"])))
                if not (child["parent_key"] and child["parent_key"] == parent["item_key"]) and not (at is not None and least and shared / least >= 0.5):
                    continue
                take_child(parent, child, at)
                gone.add(j)
        out = pd.DataFrame([r for k, r in enumerate(rows) if k not in gone], columns=group.columns)
        return out[COLUMNS]

    return title_keys(records).groupBy("project", "chapter").applyInPandas(fold, RECORD)


def take_child(parent: dict, child: dict, at: int | None) -> None:
    """Child bullets under the child's title; the one that had the title gives its sources."""
    for n, (b, key) in enumerate(zip(child["bullets"], child["bullet_keys"], strict=True)):
        joined = f"{child['title']}·{b['title']}"
        if n == 0 or key == child["title_key"]:
            title, key = child["title"], child["title_key"]
        elif len(joined) <= 25:
            title, key = joined, f"{child['title_key']}·{key}"
        else:
            title = b["title"]
        new = b | {"title": title}
        spot = at if n == 0 else None
        if at is None and key in parent["bullet_keys"]:
            unite_sources(parent["bullets"][parent["bullet_keys"].index(key)], new)
        elif spot is not None:
            unite_sources(new, parent["bullets"][spot])
            parent["bullets"][spot] = new
        else:
            parent["bullets"].append(new)
            parent["bullet_keys"].append(key)
    parent["candidates"] = list(dict.fromkeys([*parent["candidates"], *child["candidates"]]))


def unite_sources(bullet: dict, other: dict) -> None:
    bullet["chunk_ids"] = list(dict.fromkeys([*bullet["chunk_ids"], *other["chunk_ids"]]))
    bullet["pages"] = sorted({*bullet["pages"], *other["pages"]})


def record_versions(records: DataFrame) -> DataFrame:
    """Records in the form of material: point is the record, bullet its place."""
    b = records.select("project", "chapter", F.col("record").alias("point"), F.col("title").alias("point_title"), F.posexplode("bullets").alias("bullet", "b"))
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col("b").getField(k), F.lit("")).alias("content")) for k in KINDS]))
    return b.select("project", "chapter", "point", "point_title", F.col("bullet").cast("long").alias("bullet"), F.coalesce("b.title", F.lit("")).alias("title"), kinds.alias("v")).select("*", "v.kind", "v.content").drop("v")


def organize_records(records: DataFrame) -> DataFrame:
    """Duplicates merged, children folded, then bullets that repeat another record's title in the chapter go, richer ones
    after they were merged into that record; records left without bullets vanish."""
    folded_ = written(fold_children(deduplicate_records(records)), "folded")
    plan = written(collisions(record_versions(folded_)).select("project", "chapter", F.col("point").alias("record"), "bullet", "target", "merge"), "collisions")
    key = ["project", "chapter", "record"]
    gone = plan.groupBy(*key).agg(F.collect_set("bullet").alias("gone"))
    merged = merge_records(folded_, plan.where("merge")).join(gone, key, "left")
    left = F.filter("bullets", lambda b, i: ~F.coalesce(F.array_contains("gone", i.cast("long")), F.lit(False)))
    return merged.withColumn("bullets", left).where("size(bullets) > 0").select(*COLUMNS)


def merge_records(records: DataFrame, merges: DataFrame) -> DataFrame:
    """records with the bullets in ``merges`` (project, chapter, record, bullet, target) merged into their targets, as merge_versions does it."""
    scope = ["project", "chapter"]
    involved = merges.select(*scope, F.col("target").alias("record")).unionByName(merges.select(*scope, "record")).distinct()
    still = records.join(involved, [*scope, "record"], "left_anti")
    actions = merges.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("record", "bullet", "target"))).alias("actions"))
    moving = records.join(involved, [*scope, "record"]).join(actions, scope).select(*COLUMNS, "actions")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        rows = {r["record"]: r | {"bullets": [dict(b) for b in r["bullets"]]} for r in group.to_dict("records")}
        for a in group["actions"].iloc[0]:
            owner, target = rows[a["record"]], rows[a["target"]]
            move_record_bullet(target["bullets"], owner["bullets"][a["bullet"]])
            target["candidates"] = list(dict.fromkeys([*target["candidates"], *owner["candidates"]]))
        return pd.DataFrame(list(rows.values()), columns=group.columns)[COLUMNS]

    return still.unionByName(moving.groupBy(*scope).applyInPandas(fold, RECORD))


def move_record_bullet(bullets: list[dict], incoming: dict) -> None:
    """Merges texts by kind and sources into the bullet whose original shares most terms, the first of equals."""
    wanted = term_set(incoming["original"] or "")
    shared = [len(term_set(b["original"] or "") & wanted) for b in bullets]
    best = bullets[shared.index(max(shared))]
    for kind in KINDS:
        best[kind] = merged_content(kind, best[kind] or "", incoming[kind] or "")
    unite_sources(best, incoming)


def canonical_material(versions: DataFrame) -> DataFrame:
    """versions without bullets that collide with another point's title; points without bullets vanish with them.

    What a bullet has beyond its target is not lost: if it is richer, it is merged into the target's bullet that shares most
    terms with it, before it goes.  ``sources``, an array of chunk ids, is united where versions have that column.
    """
    plan = collisions(versions)
    merged = merge_versions(versions, plan.where("merge"))
    return merged.join(plan.select("project", "chapter", "point", "bullet"), ["project", "chapter", "point", "bullet"], "left_anti")


def merged_one_by_one(versions: DataFrame) -> DataFrame:
    """canonical_material where every richer bullet is merged by itself: texts are united with those that the target's bullet
    was given, and a bullet that takes several has its versions once for each of them.

    So the order of merges plays no part, and a chapter's merges need not meet in one group.
    """
    scope = ["project", "chapter"]
    key = [*scope, "point", "bullet"]
    plan = written(collisions(versions), "collisions")
    merges = plan.where("merge").select(*key, "target")
    involved = merges.select(*scope, "point").unionByName(merges.select(*scope, F.col("target").alias("point"))).distinct()
    own = versions.join(involved, [*scope, "point"], "left_semi").groupBy(*key).agg(T.terms(F.array_join(F.collect_list("content"), " ")).alias("terms"))
    into = own.select(*scope, F.col("point").alias("target"), F.col("bullet").alias("into"), F.col("terms").alias("there"))
    pairs = merges.join(own, key).join(into, [*scope, "target"]).withColumn("shared", F.size(F.array_intersect("terms", "there")))
    best = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("shared"), "into"))
    goes = pairs.withColumn("n", best).where("n = 1").select(*key, "target", "into")
    moved = versions.join(goes, key)
    place = {"point": "target", "bullet": "into"}
    taken = written(moved.select(*[F.col(place.get(c, c)).alias(c) for c in versions.columns]), "taken")
    more = taken.select(*key, "kind", F.col("content").alias("more"))
    united = F.when(F.col("more").isNull(), F.col("content")).otherwise(T.merge_content(F.col("kind"), F.col("content"), F.col("more")))
    merged = versions.join(more, [*key, "kind"], "left").withColumn("content", united).select(*versions.columns)
    added = taken.join(versions.select(*key, "kind"), [*key, "kind"], "left_anti")
    return merged.unionByName(added).join(plan.select(*key), key, "left_anti")


def merge_versions(versions: DataFrame, merges: DataFrame) -> DataFrame:
    """versions with the bullets in ``merges`` (project, chapter, point, bullet, target) merged into their targets.

    One merge may change what the next one moves or meets, so those of a chapter are done in order in one group; only points
    that give or take bullets, of a chapter with any, reach it.  The others stay as they are.
    """
    scope = ["project", "chapter"]
    takes = merges.select(*scope, F.col("target").alias("point"))
    involved = takes.unionByName(merges.select(*scope, "point")).distinct()
    still = versions.join(involved, [*scope, "point"], "left_anti")
    actions = merges.groupBy(*scope).agg(F.array_sort(F.collect_list(F.struct("point", "bullet", "target"))).alias("actions__"))
    moving = versions.join(involved, [*scope, "point"]).join(actions, scope).select(*versions.columns, "actions__")

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        points: dict = {}
        for r in group.drop(columns="actions__").to_dict("records"):
            points.setdefault(r["point"], {}).setdefault(r["bullet"], {})[r["kind"]] = r
        for a in group["actions__"].iloc[0]:
            move_bullet(points[a["target"]], points[a["point"]][a["bullet"]])
        rows = [v for bullets in points.values() for own in bullets.values() for v in own.values()]
        return pd.DataFrame(rows, columns=[c for c in group.columns if c != "actions__"])

    return still.unionByName(moving.groupBy(*scope).applyInPandas(fold, versions.schema))


def term_set(text: str) -> set[str]:
    return set(_TERM.findall(folded(text)))


def merged_content(kind: str, a: str, b: str) -> str:
    """text.merge_content of single strings."""
    keywords = kind == "keywords"
    joiner = "、" if keywords else "\n\n"
    pieces = (_BLANKS.sub(" ", p).strip(" ") for p in (_KEYWORDS if keywords else _PARAGRAPHS).split(f"{a}{joiner}{b}"))
    first: dict[str, str] = {}
    for p in pieces:
        if p:
            first.setdefault(folded(p), p)
    return joiner.join(first.values())


def move_bullet(target: dict, bullet: dict) -> None:
    """Merges versions by kind into the target's bullet that shares most terms, the first of equals."""
    text = lambda own: term_set(" ".join(v["content"] or "" for _, v in sorted(own.items(), key=lambda x: KINDS.index(x[0]) if x[0] in KINDS else 9)))
    wanted = text(bullet)
    at = max(sorted(target), key=lambda b: len(text(target[b]) & wanted))
    own, new = target[at], list(bullet.items())
    for kind, v in new:
        old = own.get(kind)
        if old is None:
            there = next(iter(own.values()))
            own[kind] = v | {k: there[k] for k in ("point", "point_title", "bullet") if k in there}
        else:
            own[kind] = old | {"content": merged_content(kind, old["content"] or "", v["content"] or "")}
    if any("sources" in v for v in own.values()):
        united = list(dict.fromkeys(c for v in [*own.values(), *bullet.values()] for c in (v.get("sources") if v.get("sources") is not None else ())))
        for v in own.values():
            v["sources"] = united


def diagnostic_collisions(versions: DataFrame) -> DataFrame:
    """project, chapter, points named by others' bullets and how many bullets do so."""
    return collisions(versions).groupBy("project", "chapter", "target").agg(F.count("*").alias("bullets"))


def build_material(records: DataFrame, chapters: DataFrame, unresolved: str = "__unresolved_chapter__") -> DataFrame:
    """project, chapter_position, chapter, point_position, record: records by resolved chapter in first-seen order.

    chapters: project, record, resolved.
    """
    j = records.join(chapters, ["project", "record"], "left").withColumn("resolved", F.coalesce("resolved", F.lit(unresolved)))
    seen = j.groupBy("project", "resolved").agg(F.min("record").alias("first"))
    placed = seen.withColumn("chapter_position", F.row_number().over(Window.partitionBy("project").orderBy("first")) - 1)
    point = F.row_number().over(Window.partitionBy("project", "resolved").orderBy("record")) - 1
    return j.withColumn("point_position", point).join(placed.drop("first"), ["project", "resolved"]).select("project", "chapter_position", F.col("resolved").alias("chapter"), "point_position", "record", "title")


def compose_material(records: DataFrame, candidates: DataFrame, chunk_chapters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Material with the chapter that each record's citations vote for, and its source links.

    candidates: project, idx (the record), chunk_id, score, page_start, page_end; chunk_chapters: chunk_id, chapter.  Only
    chunks that are candidates of the record count and are linked.
    """
    from .matching import source_links, vote_chapter

    cited = records.select("project", F.col("record").alias("idx"), F.posexplode("bullets").alias("bullet", "b")).select("project", "idx", "bullet", F.col("b.chunk_ids").alias("chunk_ids"), F.array().cast("array<bigint>").alias("pages"))
    voted = vote_chapter(cited, candidates, chunk_chapters).select("project", F.col("idx").alias("record"), F.col("chapter").alias("resolved"))
    return build_material(records, voted), source_links(cited, candidates)
