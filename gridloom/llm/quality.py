"""Quality rules: statistics of each text, and a decision list learned from labelled ones.

Everything runs in the JVM. Statistics need no shuffle: one row in, one row out, each in time near
linear in the text. The list is learned by sequential covering on a bounded sample of labelled rows
and then emitted as one ordered CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, strip, words

#: Documents of fewer words, or with a larger share of repeated words, fail whatever the list says.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
#: At most so many labelled documents are used to learn the list; those of the smallest id hashes.
SAMPLE_ROWS = 4000
FEATURES = ("n_words", "mean_word", "symbol_rate", "dup_line_rate", "repeat_rate", "line_words")


def repeated_words(w: Column, window: int = WINDOW) -> Column:
    """Words inside windows of `window` words found twice or more in `w`, the first find included.

    Windows are held as 64-bit hashes. Texts without an equal pair, nearly all, end at a hash set;
    in others the windows are sorted with their places and the covered places are counted.
    """
    hashes = F.when(F.size(w) >= window, F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(window)]))).otherwise(F.array().cast("array<bigint>"))

    def covered(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(pairs, lambda s: F.filter(s, lambda e, i: (F.get(s, i - 1)["h"] == e["h"]) | (F.get(s, i + 1)["h"] == e["h"])))
        places = F.sort_array(F.transform(twice, lambda e: e["i"]))
        steps = let(places, lambda p: F.zip_with(p, F.slice(p, 2, F.greatest(F.size(p), F.lit(1))), lambda a, b: F.coalesce(F.least(F.lit(window), b - a), F.lit(window))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda acc, x: acc + x)

    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("bigint")).otherwise(covered(h)))


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with the statistics of the whole of column `text` as new columns under `stat`, a struct.

    Null text counts as empty: all counts 0 and rates 0. Other columns, of any name, are kept.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    parts = F.struct(
        words(F.col(text)).alias("w"),
        F.filter(F.split(t, "\n", -1), lambda x: strip(x) != "").alias("lines"),
        (F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]+", ""))).cast("bigint").alias("n_symbols"),
    )

    def counts(p: Column) -> Column:
        return F.struct(
            F.size(p["w"]).cast("bigint").alias("n_words"),
            F.length(F.array_join(p["w"], "")).cast("bigint").alias("word_chars"),
            p["n_symbols"].alias("n_symbols"),
            F.size(p["lines"]).cast("bigint").alias("n_lines"),
            (F.size(p["lines"]) - F.size(F.array_distinct(p["lines"]))).cast("bigint").alias("n_dup_lines"),
            let(p["w"], repeated_words).alias("n_repeat_words"),
        )

    return docs.withColumn("stat", let(parts, counts))


def features(s: Column) -> dict[str, Column]:
    """The learner's statistics, as doubles, from the struct of statistics()."""
    per = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return {
        "n_words": s["n_words"].cast("double"),
        "mean_word": per(s["word_chars"], s["n_words"]),
        "symbol_rate": per(s["n_symbols"], s["n_words"]),
        "dup_line_rate": per(s["n_dup_lines"], s["n_lines"]),
        "repeat_rate": per(s["n_repeat_words"], s["n_words"]),
        "line_words": per(s["n_words"], s["n_lines"]),
    }


def base_failed(s: Column) -> Column:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > MAX_REPEAT_PERCENT * s["n_words"])


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, is the test >=, threshold); rows that meet all of it are rejected."""

    tests: tuple[tuple[str, bool, float], ...]

    def holds(self, row: dict[str, float]) -> bool:
        return all((row[f] >= x) if up else (row[f] < x) for f, up, x in self.tests)

    def column(self, cols: dict[str, Column]) -> Column:
        out = F.lit(True)
        for f, up, x in self.tests:
            out = out & ((cols[f] >= x) if up else (cols[f] < x))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{f} {'>=' if up else '<'} {x:.6g}" for f, up, x in self.tests)


def _score(rule: Rule, rows: list) -> tuple[int, int]:
    hit = [y for x, y in rows if rule.holds(x)]
    return sum(hit), len(hit) - sum(hit)


def _grown(rows: list, names: tuple[str, ...], max_tests: int, cuts: int, barred: set[tuple[str, bool]]) -> Rule:
    """Adds the test with the largest information gain for the rejected class until none is of use. The first test is none of the `barred` kinds (feature, is it >=)."""
    from math import log2

    tests: list[tuple[str, bool, float]] = []
    left = rows
    while len(tests) < max_tests:
        pos = sum(y for _, y in left)
        neg = len(left) - pos
        if not pos or not neg:
            break
        now, best = log2(pos / (pos + neg)), (0.0, None)
        for f in names:
            order = sorted((x[f], y) for x, y in left)
            total, below, seen = (pos, neg), [0, 0], 0
            step = max(1, len(order) // cuts)
            last = None
            for k, (v, y) in enumerate(order):
                if v != last and seen >= step and last is not None:
                    seen, cut = 0, (v + last) / 2
                    for up, p, n in ((False, below[0], below[1]), (True, total[0] - below[0], total[1] - below[1])):
                        if p and (tests or (f, up) not in barred) and (gain := p * (log2(p / (p + n)) - now)) > best[0]:
                            best = (gain, (f, up, cut))
                below[1 - y] += 1
                seen += 1
                last = v
        if best[1] is None:
            break
        tests.append(best[1])
        left = [(x, y) for x, y in left if Rule((best[1],)).holds(x)]
    return Rule(tuple(tests))


def learn(rows: list[tuple[dict[str, float], int]], names: tuple[str, ...] = FEATURES, min_precision: float = 0.97, min_cover: int = 5, max_rules: int = 12, max_tests: int = 4, cuts: int = 200) -> list[Rule]:
    """An ordered list of rejecting rules by sequential covering. rows: (features, 1 if of bad quality).

    Two thirds of the rows grow a rule, one third prunes its tests from the end; a rule stays if, on
    each of the two parts, it is right for `min_precision` of the rows it rejects (smoothed on the
    pruning part), so that good documents are left alone. Where a rule doesn't stay, the search goes on with rules
    that begin with a test of another kind, until none is left. Rows must come in a fixed order. No rows, or one
    class: an empty list, which keeps all.
    """
    rules: list[Rule] = []
    grow, prune = [r for i, r in enumerate(rows) if i % 3], rows[::3]
    barred: set[tuple[str, bool]] = set()
    while len(rules) < max_rules and sum(y for _, y in grow) >= min_cover:
        rule = _grown(grow, names, max_tests, cuts, barred)
        if not rule.tests:
            break

        def worth(r: Rule) -> float:
            p, n = _score(r, prune)
            return (p - n) / (p + n) if p + n else -1.0

        best = max((Rule(rule.tests[:k]) for k in range(1, len(rule.tests) + 1)), key=lambda r: (round(worth(r), 3), -len(r.tests)))
        (p, n), (pg, ng) = _score(best, prune), _score(best, grow)
        if pg < min_cover or pg / (pg + ng) < min_precision or (p + 1) / (p + n + 1) < min_precision:
            barred.add(rule.tests[0][:2])
            continue
        rules.append(best)
        barred.clear()
        grow = [(x, y) for x, y in grow if not best.holds(x)]
        prune = [(x, y) for x, y in prune if not best.holds(x)]
    return rules


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS) -> list[tuple[dict[str, float], int]]:
    """At most `max_rows` labelled documents that pass the base test, in a fixed order, as learn() takes them.

    Labels without a document, null labels and null ids don't count; of two labels of an id the lower does.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    stats = statistics(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id"))
    cols = features(F.col("stat"))
    # who fails the base test is dropped here: as a filter, the test would be pushed below the join and made for all documents
    found = stats.select("doc_id", "label", F.xxhash64("doc_id").alias("at"), base_failed(F.col("stat")).alias("failed"), *[c.alias(k) for k, c in cols.items()]).collect()
    found = sorted((r for r in found if not r["failed"]), key=lambda r: (r["at"], r["doc_id"], tuple(r[k] for k in cols)))
    return [({k: r[k] for k in cols}, int(r["label"] == 0)) for r in found]


def verdict(rules: list[Rule], s: Column) -> Column:
    """The ordered conditional expression of the list: False for what a rule rejects, else True."""
    cols, out = features(s), None
    for rule in rules:
        out = F.when(rule.column(cols), F.lit(False)) if out is None else out.when(rule.column(cols), F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def judged(docs: DataFrame, labels: DataFrame, max_rows: int = SAMPLE_ROWS) -> DataFrame:
    """`docs` with `stat`, `base_failed` and `kept`; the list is learned from `labels` (doc_id, quality) of `docs`.

    Null and empty texts have no words and fail the base test. Every row is judged by itself: repeated rows and rows
    without id too. No rows: no rows. All other columns stay; `stat`, `base_failed` and `kept` of the input, if any,
    are replaced.
    """
    rules = learn(labelled_sample(docs, labels, max_rows))
    out = statistics(docs)
    return out.withColumn("base_failed", base_failed(F.col("stat"))).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules, F.col("stat"))))
