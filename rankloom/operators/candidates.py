"""Functions over ordered candidate arrays; all are built-in expressions inside one row, none shuffles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: emoji, symbols, arrows, Cyrillic and Greek.
GARBAGE = "[\\x{1F300}-\\x{1FAFF}\\x{2600}-\\x{27BF}\\x{2190}-\\x{21FF}\\x{0400}-\\x{04FF}\\x{0370}-\\x{03FF}]"


def or_empty(candidates: Column) -> Column:
    """Null lists count as empty."""
    return F.coalesce(candidates, F.array().cast("array<string>"))


def dedupe(candidates: Column) -> Column:
    """Ordered distinct without empty or null elements."""
    return F.array_distinct(F.filter(or_empty(candidates), lambda x: x.isNotNull() & (x != "")))


def rank_of(target: Column, candidates: Column) -> Column:
    """1-based place of the target, else null."""
    return F.nullif(F.array_position(or_empty(candidates), target), F.lit(0).cast("bigint"))


def rank_exact_then(target: Column, candidates: Column, target_norm: Column, candidate_norms: Column) -> Column:
    """Place of the exact target; only where that is missing the place under the norm; an empty norm has none."""
    loose = F.when(target_norm != "", rank_of(target_norm, candidate_norms))
    return F.coalesce(rank_of(target, candidates), loose)


def member(target_norm: Column, candidate_norms: Column) -> Column:
    """Null lists stay unknown, an empty target is always there."""
    return F.when(candidate_norms.isNull(), F.lit(None).cast("boolean")).when(target_norm == "", F.lit(True)).otherwise(F.coalesce(F.array_contains(candidate_norms, target_norm), F.lit(False)))


def sanitize(candidates: Column) -> Column:
    """Ordered distinct without emoji, arrows, Greek, Cyrillic and symbol-only elements."""
    return F.filter(dedupe(candidates), lambda x: ~x.rlike(GARBAGE) & (~x.rlike("(?U)^[\\W_]+$") | x.rlike("[぀-ヿ一-鿿]")))


def cap(candidates: Column, n: int) -> Column:
    return F.slice(or_empty(candidates), 1, n)


def cap_keeping(candidates: Column, keep: Column, n: int) -> Column:
    """The first n; where the kept one is not among them it comes first and the list is cut again."""
    head = cap(candidates, n)
    return F.when(keep.isNull() | (keep == "") | F.array_contains(head, keep), head).otherwise(F.slice(F.concat(F.array(keep), F.array_remove(head, keep)), 1, n))


def ensure(candidates: Column, wanted: Column) -> Column:
    """Put the wanted one first where it is absent."""
    own = or_empty(candidates)
    return F.when(wanted.isNull() | F.array_contains(own, wanted), own).otherwise(F.concat(F.array(wanted), own))


def best_index(scores: Column) -> Column:
    """1-based place of the highest score, the first one of ties; null for no scores."""
    top = F.array_max(F.transform(scores, lambda x, i: F.struct(x.alias("s"), (-i).alias("i"))))
    return F.when(F.size(scores) > 0, F.lit(1) - top["i"])


def score_at(candidates: Column, scores: Column, text: Column) -> Column:
    """The score of a text's first occurrence, else null."""
    place = F.array_position(candidates, text).cast("int")
    return F.when(place > 0, F.try_element_at(scores, place))


def ranked(candidates: Column, scores: Column) -> Column:
    """Candidates by falling score, ties in their order."""
    pairs = F.transform(candidates, lambda x, i: F.struct((-F.get(scores, i)).alias("s"), i.alias("i"), x.alias("c")))
    return F.transform(F.array_sort(pairs), lambda x: x["c"])


def final_first(order: Column, final: Column) -> Column:
    """The decided one first, the others as they were."""
    return F.concat(F.array(final), F.array_remove(order, final))


def reorder(candidates: Column, order: Column) -> Column:
    """A list in the given order; what the order does not name keeps its place behind."""
    inside = F.filter(order, lambda x: F.array_contains(candidates, x))
    return F.concat(inside, F.filter(candidates, lambda x: ~F.array_contains(order, x)))


def inject_tail(candidates: Column, candidate_norms: Column, extras: Column, extra_norms: Column, most: int) -> Column:
    """Append at most ``most`` extras whose norm is new."""
    pairs = F.filter(F.arrays_zip(extras.alias("e"), extra_norms.alias("n")), lambda x: (x["n"] != "") & ~F.array_contains(candidate_norms, x["n"]))
    return F.concat(or_empty(candidates), F.slice(F.transform(pairs, lambda x: x["e"]), 1, most))


def negatives(target: Column, candidates: Column, most: int = 15) -> Column:
    """At most ``most`` distinct candidates other than the target."""
    return F.slice(F.array_remove(dedupe(candidates), target), 1, most)


def hit_at(target: Column, candidates: Column, k: int) -> Column:
    return F.coalesce(F.array_contains(cap(candidates, k), target), F.lit(False))


def paths(segments: Column, whole: Column, most: int) -> Column:
    """Whole candidates out of segments with alternates: the best path, then each segment's alternates with the others at
    their best, then the candidates of the whole key; each once, at most ``most``.  Segments without alternates count as empty.
    """
    best = F.transform(segments, lambda s: F.coalesce(F.get(s, F.lit(0)), F.lit("")))
    first = F.array(F.array_join(best, ""))

    def alternates(s: Column, i: Column) -> Column:
        before, after = F.array_join(F.slice(best, F.lit(1), i), ""), F.array_join(F.slice(best, i + 2, F.size(best)), "")
        return F.transform(F.slice(s, F.lit(2), F.greatest(F.size(s) - 1, F.lit(0))), lambda x: F.concat(before, x, after))

    return cap(dedupe(F.concat(first, F.flatten(F.transform(segments, alternates)), or_empty(whole))), most)
