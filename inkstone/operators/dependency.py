"""Dependency heads from parts of speech, by windows over positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Classes of tags that rules look for.
VERB, VERBAL, NOUN, NOMINAL = ("v",), ("v", "a"), ("n", "ns", "nt", "nr"), ("n", "r", "ns", "nr", "nt")
CASE_HEAD, PLACE_HEAD = ("v", "n", "r", "ns", "nt"), ("n", "ns", "nt", "nr", "f")


def dependency_heads(tagged: DataFrame) -> DataFrame:
    """(id, pos, word, tag, head, relation) of (id, pos, word, tag) rows; positions of a sentence count 0, 1, ..., the root's head is -1.

    The root is the first verb, else the first adjective, else the first nominal, else the first word. Heads are the nearest
    word of a class before or after; where there is none, the next or previous word, or the root. Heads may form cycles.
    """
    whole = W.partitionBy("id")
    after = whole.orderBy("pos").rowsBetween(1, W.unboundedFollowing)
    before = whole.orderBy("pos").rowsBetween(W.unboundedPreceding, -1)

    def of(tags: tuple[str, ...]) -> Column:
        return F.when(F.col("tag").isin(*tags), F.col("pos"))

    def nxt(tags: tuple[str, ...]) -> Column:
        return F.min(of(tags)).over(after)

    def prev(tags: tuple[str, ...]) -> Column:
        return F.max(of(tags)).over(before)

    found = tagged.withColumns({
        "root": F.coalesce(F.min(of(VERB)).over(whole), F.min(of(("a",))).over(whole), F.min(of(NOMINAL)).over(whole), F.lit(0)),
        "n": F.count("*").over(whole), "next_v": nxt(VERB), "next_va": nxt(VERBAL), "next_case": nxt(CASE_HEAD), "next_n": nxt(NOUN), "prev_v": prev(VERB), "prev_place": prev(PLACE_HEAD),
    })
    root, tag, pos = F.col("root"), F.col("tag"), F.col("pos")
    left = F.when(pos > 0, pos - 1).otherwise(root)
    right = F.when(pos + 1 < F.col("n"), pos + 1).otherwise(root)
    nominal = tag.isin(*NOMINAL)
    head = (
        F.when(pos == root, -1)
        .when(tag == "u", left)
        .when(tag == "d", F.coalesce("next_va", right))
        .when(tag == "p", F.coalesce("next_case", right))
        .when(tag == "c", F.coalesce("next_v", right))
        .when(tag.isin("m", "q"), F.coalesce("next_n", left))
        .when(tag == "a", F.coalesce("next_n", root))
        .when(tag == "f", F.coalesce("prev_place", left))
        .when(tag == "t", root)
        .when(nominal, F.coalesce("next_v", "prev_v", "next_n", root))
        .when(tag == "v", root)
        .otherwise(left)
    )
    relation = (
        F.when(pos == root, "root")
        .when(tag == "u", "mark")
        .when(tag == "d", "advmod")
        .when(tag == "p", "case")
        .when(tag == "c", "conj")
        .when(tag.isin("m", "q"), F.when((tag == "q") & F.col("next_n").isNotNull(), "clf").otherwise("nummod"))
        .when(tag == "a", F.when(F.col("next_n").isNotNull(), "amod").otherwise("dep"))
        .when(tag == "f", "lobj")
        .when(tag == "t", "tmod")
        .when(nominal, F.when(F.col("next_v").isNotNull(), "nsubj").when(F.col("prev_v").isNotNull(), "dobj").when(F.col("next_n").isNotNull(), "compound").otherwise("dep"))
        .when(tag == "v", "conj")
        .otherwise("dep")
    )
    return found.select("id", "pos", "word", "tag", head.cast("int").alias("head"), relation.alias("relation"))


def heads_of(tags: list[str]) -> tuple[list[int], list[str]]:
    """(heads, relations) of one sentence in memory, by the same rules."""
    n = len(tags)
    if not n:
        return [], []

    def nearest(wanted: tuple[str, ...], step: int) -> list[int | None]:
        out: list[int | None] = [None] * n
        last = None
        for i in range(n - 1, -1, -1) if step > 0 else range(n):
            out[i] = last
            if tags[i] in wanted:
                last = i
        return out

    nv, nva, nc, nn = (nearest(x, 1) for x in (VERB, VERBAL, CASE_HEAD, NOUN))
    pv, pp = nearest(VERB, -1), nearest(PLACE_HEAD, -1)
    root = next((i for wanted in (VERB, ("a",), NOMINAL) for i, t in enumerate(tags) if t in wanted), 0)
    heads, relations = [], []
    for i, t in enumerate(tags):
        left, right = (i - 1 if i else root), (i + 1 if i + 1 < n else root)
        pick = lambda *xs: next(x for x in xs if x is not None)
        if i == root:
            h, r = -1, "root"
        elif t == "d":
            h, r = pick(nva[i], right), "advmod"
        elif t == "p":
            h, r = pick(nc[i], right), "case"
        elif t == "c":
            h, r = pick(nv[i], right), "conj"
        elif t in ("m", "q"):
            h, r = pick(nn[i], left), "clf" if t == "q" and nn[i] is not None else "nummod"
        elif t == "a":
            h, r = pick(nn[i], root), "dep" if nn[i] is None else "amod"
        elif t == "f":
            h, r = pick(pp[i], left), "lobj"
        elif t in ("t", "v"):
            h, r = root, "tmod" if t == "t" else "conj"
        elif t in NOMINAL:
            h = pick(nv[i], pv[i], nn[i], root)
            r = "nsubj" if nv[i] is not None else "dobj" if pv[i] is not None else "compound" if nn[i] is not None else "dep"
        else:
            h, r = left, "mark" if t == "u" else "dep"
        heads.append(h)
        relations.append(r)
    return heads, relations
