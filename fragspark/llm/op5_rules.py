"""Quality rules: learned decision lists over document statistics, as ordered Spark conditions.

``statistics`` computes a document's numbers with DataFrame functions alone, in one
pass without a shuffle. ``learn`` is sequential covering: it grows one conjunction
of thresholds at a time on the labelled rows, prunes it on the held part of them, and
goes on with the rows that it doesn't cover. Every step is one aggregate over the
labelled statistics, which counts good and bad rows under all candidate thresholds at once;
only those counts reach the driver. ``verdict`` turns the list into an ordered
CASE expression: the first rule that matches decides, the default keeps.

A rule rejects, so it must be right nearly always: growth aims at precision, and a
rule enters the list only if at least ``min_precision`` of what it covers is bad, in
the grown part and in the pruning part of the labelled rows.

Null or empty text: all statistics 0. With no labelled rows, or labels of one class,
the list is empty and the base rule alone decides. Labels that repeat count as often
as they occur; null labels are left out. Columns other than those named are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fragspark.llm.shared import stored

WORD = r"[^\x20\x09-\x0D]+"
#: The characters that count as symbols.
SYMBOLS = r"[^#*$%&|<>]"
#: Ratios that rules may bound, as numerators over n_words.
FEATURES = {
    "symbols_a_word": "n_symbols / n_words",
    "chars_a_word": "word_chars / n_words",
    "repeats_a_word": "n_repeat_words / n_words",
    "dup_lines_a_line": "n_dup_lines / n_lines",
    "upper_a_char": "n_upper / word_chars",
    "digits_a_char": "n_digits / word_chars",
    "distinct_a_word": "n_distinct_words / n_words",
    "same_as_last_a_word": "n_same_as_last / n_words",
    "marks_a_word": "n_marks / n_words",
    "words": "n_words",
}


def _removed(text: Column, keep: str) -> Column:
    """How many characters a class leaves when all others are removed."""
    return F.length(F.regexp_replace(text, keep, ""))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row of counts for every row of ``docs``."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    a = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("t"))
    b = a.select(
        "doc_id",
        "t",
        F.filter(F.split("t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    n = F.size("w")
    # hashes of words stand for them within one document; three of them make the hash of a window
    c = b.select("*", F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    c = c.withColumn("tri", F.when(n >= 3, F.expr("transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2]))")).otherwise(F.expr("array()")))
    # windows found more than once, by sorting (hash, place) pairs, only where there is one
    c = c.withColumn("pairs", F.expr("CASE WHEN size(array_distinct(tri)) < size(tri) THEN sort_array(transform(tri, (x, i) -> struct(x AS x, i AS i))) END"))
    c = c.withColumn(
        "places",
        F.expr("""CASE WHEN pairs IS NOT NULL THEN sort_array(transform(
            filter(transform(pairs, (p, j) -> struct(p.i AS i, (j > 0 AND p.x = pairs[greatest(j - 1, 0)].x) OR (j < size(pairs) - 1 AND p.x = pairs[least(j + 1, size(pairs) - 1)].x) AS many)), q -> q.many),
            q -> q.i)) END"""),
    )
    covered = F.expr("CASE WHEN places IS NOT NULL THEN aggregate(transform(places, (p, j) -> IF(j = 0, 3, least(3, p - places[greatest(j - 1, 0)]))), 0, (a, x) -> a + x) ELSE 0 END")
    same = F.expr("CASE WHEN size(h) > 1 THEN size(filter(h, (x, i) -> i > 0 AND x = h[greatest(i - 1, 0)])) ELSE 0 END")
    big = lambda x: x.cast("bigint")
    t = F.col("t")
    return c.select(
        "doc_id",
        big(n).alias("n_words"),
        big(_removed(t, r"[\x20\x09-\x0D]+")).alias("word_chars"),
        big(_removed(t, SYMBOLS + "+")).alias("n_symbols"),
        big(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        big(covered).alias("n_repeat_words"),
        big(F.size("lines")).alias("n_lines"),
        big(_removed(t, r"[^A-Z]+")).alias("n_upper"),
        big(_removed(t, r"[^0-9]+")).alias("n_digits"),
        big(_removed(t, r"[^!?]+")).alias("n_marks"),
        big(F.size(F.array_distinct("h"))).alias("n_distinct_words"),
        big(same).alias("n_same_as_last"),
    )


def base_failed(min_words: int = 50, repeat_percent: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))


def features() -> dict[str, Column]:
    ratio = lambda e: F.expr(e) if "/" not in e else F.coalesce(F.try_divide(*(F.col(x.strip()) for x in e.split("/"))), F.lit(0.0))
    return {name: ratio(e).cast("double") for name, e in FEATURES.items()}


@dataclass(frozen=True)
class Term:
    feature: str
    above: bool
    threshold: float

    def column(self, values: dict[str, Column]) -> Column:
        return values[self.feature] >= self.threshold if self.above else values[self.feature] < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Term, ...]


def _all(rule: Rule, values: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a & b, (t.column(values) for t in rule), F.lit(True))


def _tally(rows: DataFrame) -> dict[int, dict[int, list[int]]]:
    """{feature: {bin: (good, bad) of the grown part, (good, bad) of the pruning part}}: one small aggregate over the labelled rows."""
    cells = rows.select("good", "held", F.posexplode("bins").alias("feature", "bin")).groupBy("feature", "bin").agg(
        *[F.count_if((F.col("good") == g) & (F.col("held") == h)) for h in (False, True) for g in (1, 0)]
    )
    out: dict[int, dict[int, list[int]]] = {}
    for r in cells.collect():  # at most a cell for every feature and cut
        out.setdefault(r[0], {})[r[1]] = list(r[2:6])
    return out


def _total(tally: dict[int, dict[int, list[int]]]) -> list[int]:
    return [sum(n[k] for n in tally.get(0, {}).values()) for k in range(4)]


def learn(
    labelled: DataFrame, max_rules: int = 6, max_terms: int = 3, cuts: int = 24, min_precision: float = 0.9, min_cover: int = 3
) -> list[Rule]:
    """An ordered list of rejecting rules. ``labelled``: statistics with ``good`` (1 or 0) and ``held`` (pruning part)."""
    values = features()
    names = list(values)
    rows = labelled.select("good", "held", *[v.alias(n) for n, v in values.items()])
    probe = [k / cuts for k in range(1, cuts)] + [0.005, 0.01, 0.02, 0.98, 0.99, 0.995]
    points = rows.agg(*[F.percentile_approx(n, probe, 2000).alias(n) for n in names], F.count_if(F.col("good") == 0).alias("bad"), F.count_if(F.col("good") == 1).alias("fine")).first()
    if not points["bad"] or not points["fine"]:
        return []
    edges = [sorted(set(points[n])) for n in names]
    bin_of = lambda n, e: F.size(F.filter(F.array(*[F.lit(x) for x in e]), lambda x: x <= F.col(n)))
    bins = F.array(*[bin_of(n, e) for n, e in zip(names, edges)])
    rows = stored(rows.select("good", "held", bins.alias("bins")), "rules-bins")
    inside = lambda rule: reduce(lambda a, b: a & b, (_binned(t, names, edges) for t in rule), F.lit(True))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        # rows that earlier rules cover are out of the game
        left = rows.where(~reduce(lambda a, b: a | b, (inside(r) for r in rules), F.lit(False)))
        rule, best, worth = (), None, []
        tally = _tally(left)
        total = _total(tally)
        for _ in range(max_terms):
            found = []
            for f, name in enumerate(names):
                cells = tally.get(f, {})
                below = [0, 0, 0, 0]
                for k, x in enumerate(edges[f]):
                    below = [a + b for a, b in zip(below, cells.get(k, [0, 0, 0, 0]))]
                    every = [sum(n[i] for n in cells.values()) for i in range(4)]
                    found += [(Term(name, False, x), below), (Term(name, True, x), [a - b for a, b in zip(every, below)])]
            scored = [(_gain(n[0], n[1], total[1]), -i) for i, (_, n) in enumerate(found) if n[1] >= min_cover]
            if not scored:
                break
            gain, i = max(scored)
            if best is not None and gain <= best + 1e-9:
                break
            best, rule = gain, (*rule, found[-i][0])
            worth.append((rule, found[-i][1]))
            if found[-i][1][0] == 0:
                break
            tally = _tally(left.where(inside(rule)))
        # pruning: of the rule's beginnings, the one that does best on rows that it wasn't grown on
        usable = [(t, n) for t, n in worth if n[1] >= min_precision * (n[0] + n[1]) and n[3] >= min_precision * (n[2] + n[3])]
        if not usable:
            break
        rules.append(max(usable, key=lambda x: (x[1][3] - 9 * x[1][2], -len(x[0])))[0])
    return rules


def _binned(term: Term, names: list[str], edges: list[list[float]]) -> Column:
    f = names.index(term.feature)
    at = F.col("bins")[f]
    cut = edges[f].index(term.threshold) + 1
    return at >= cut if term.above else at < cut


def _gain(good: int, bad: int, total_bad: int) -> float:
    """An F-measure that puts precision first."""
    precision, recall = (bad + 0.5) / (good + bad + 1), bad / max(1, total_bad)
    weight = 0.25
    return (1 + weight) * precision * recall / max(1e-12, weight * precision + recall)


def verdict(rules: list[Rule], values: dict[str, Column]) -> tuple[Column, Column]:
    """(kept, the number of the deciding rule): the rules' conditions in order, then the default."""
    if not rules:
        return F.lit(True), F.lit(0)
    kept = number = None
    for i, rule in enumerate(rules):
        c = _all(rule, values)
        kept = F.when(c, False) if kept is None else kept.when(c, False)
        number = F.when(c, i + 1) if number is None else number.when(c, i + 1)
    return kept.otherwise(True), number.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Statistics, base_failed, kept and the number of the rule that decided, for every row of ``docs``."""
    stats = stored(statistics(docs, id_col, text_col), "rules")
    marks = labels.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{label_col}`").cast("int").alias("good")).where("good in (0, 1)")
    held = (F.crc32(F.col("doc_id").cast("string")) % 3 == 2).alias("held")
    labelled = stored(stats.join(marks, "doc_id").where(~base_failed()).select("*", held), "rules-labelled")
    rules = learn(labelled)
    kept, number = verdict(rules, features())
    return stats.select("*", base_failed().alias("base_failed"), number.cast("int").alias("rule")).withColumn("kept", ~F.col("base_failed") & kept)
