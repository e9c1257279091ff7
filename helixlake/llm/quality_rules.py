"""Quality rules as a ledger of bitmasks, on DataFrame functions alone.

Every rule is evaluated once per document. The ledger keeps the measurements and one
bit per rule that failed; policies are versioned masks over these bits, so a new
policy, and what each rule of it costs, is read from the ledger without the texts.
All measurements of a document come from its own row: nothing is shuffled, whatever
its source, and a long text costs n log n of its own words.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import WORD

_SPACE = r"[\x20\x09-\x0D]+"
#: Fixed value: the characters that count as symbols.
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document fails where ``fails`` (SQL on the measurements) is true."""

    name: str
    fails: str


@dataclass(frozen=True)
class Policy:
    """A document is kept if none of ``hard`` and at most ``most_soft`` of ``soft`` failed."""

    version: str
    hard: tuple[str, ...]
    soft: tuple[str, ...] = ()
    most_soft: int = 0


#: Bit i of a ledger is rule i. Rules are only ever added at the end: stored bits keep their meaning.
RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 20 * n_words"),
    Rule("few_letters", "2 * n_letters < word_chars"),
    Rule("bullet_lines", "10 * n_bullet_lines > 9 * n_lines"),
)

#: The first version has the base rules; the second adds marks of lists, code and encoded data.
POLICIES = (
    Policy("v1", hard=("few_words", "repeated_words")),
    Policy("v2", hard=("few_words", "repeated_words", "many_symbols", "few_letters"), soft=("duplicate_lines", "short_words", "long_words", "bullet_lines"), most_soft=1),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` reads it."""
    return F.get(F.transform(F.array(value), body), 0)


def repeated_words(words: Column, window: int = 3) -> Column:
    """How many words lie in windows of ``window`` words that the text has twice or more.

    Windows are sorted by (hash, words, place): equal ones are neighbours, and only equal
    hashes are compared as words, so the count is exact. The places of windows that have an
    equal neighbour, in order, each cover what the next does not.
    """

    def keyed(w):
        at = lambda i: [F.get(w, i + j) for j in range(window)]
        row = lambda i: F.struct(F.xxhash64(*at(i)).alias("h"), *[c.alias(f"w{j}") for j, c in enumerate(at(i))], i.alias("i"))
        return F.sort_array(F.transform(F.sequence(F.lit(0), F.size(w) - window), row))

    def same(a, b):
        equal = a["h"] == b["h"]
        for j in range(window):
            equal = equal & (a[f"w{j}"] == b[f"w{j}"])
        return F.coalesce(equal, F.lit(False))

    def twice(s):
        there = F.filter(F.transform(s, lambda x, i: F.when(same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)), x["i"])), lambda i: i.isNotNull())
        return F.sort_array(there)

    def covered(p):
        own = F.transform(p, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(p, i + 1) - x, F.lit(window))).cast("long"))
        return F.aggregate(own, F.lit(0).cast("long"), lambda a, x: a + x)

    return F.when(F.size(words) > window, _let(keyed(words), lambda s: _let(twice(s), covered))).otherwise(F.lit(0).cast("long"))


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_bullet_lines, n_letters, n_repeat_words.

    Lines without a word count nowhere; a line is a duplicate if an earlier one is equal.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split("_text", _SPACE), lambda w: w != "")
    lines = F.filter(F.split("_text", "\n"), lambda x: F.rlike(x, F.lit(WORD)))
    without = lambda pattern: F.length(F.regexp_replace("_text", pattern, ""))
    row = docs.select(F.col(id_col).alias("_id"), text.alias("_text"))
    one = row.select("_id", _let(F.struct(words.alias("w"), lines.alias("l"), F.col("_text").alias("t")), lambda v: F.struct(
        F.size(v["w"]).cast("long").alias("n_words"),
        F.size(v["l"]).cast("long").alias("n_lines"),
        (F.size(v["l"]) - F.size(F.array_distinct(v["l"]))).cast("long").alias("n_dup_lines"),
        F.size(F.filter(v["l"], lambda x: F.rlike(x, F.lit(r"^[\x20\x09-\x0D]*[-*•]")))).cast("long").alias("n_bullet_lines"),
        repeated_words(v["w"]).alias("n_repeat_words"),
    )).alias("m"), without(_SPACE).cast("long").alias("word_chars"), (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length("_text") - without(r"\p{L}+")).cast("long").alias("n_letters"))
    names = ["n_words", "n_lines", "n_dup_lines", "n_bullet_lines", "n_repeat_words"]
    return one.select(F.col("_id").alias(id_col), *[F.col(f"m.{n}").alias(n) for n in names], "word_chars", "n_symbols", "n_letters")


def quality_ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id, the measurements and ``failures``, bit i for rule i.

    A null or empty text has no words and no lines; rows that repeat, and null ids, are rows
    of their own; other columns are neither read nor returned; an empty table gives an empty
    one. A very long text is measured whole, in the memory of its own words.
    """
    if len(rules) > 63 or len({r.name for r in rules}) < len(rules):
        raise ValueError("a ledger has at most 63 rules, each with a name of its own")
    bits = F.lit(0).cast("long")
    for i, rule in enumerate(rules):
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured(docs, id_col, text_col).withColumn("failures", bits)


def mask(names: tuple[str, ...], rules: tuple[Rule, ...] = RULES) -> int:
    """The bits of rules by name; an unknown name is an error."""
    place = {r.name: i for i, r in enumerate(rules)}
    return sum(1 << place[n] for n in set(names))


def verdict(policy: Policy, rules: tuple[Rule, ...] = RULES, failures: Column | None = None, without: int = 0) -> Column:
    """Whether a policy keeps a row with these failure bits; bits of ``without`` are not looked at."""
    bits = F.col("failures") if failures is None else failures
    hard, soft = mask(policy.hard, rules) & ~without, mask(policy.soft, rules) & ~without
    return (bits.bitwiseAND(F.lit(hard).cast("long")) == 0) & (F.bit_count(bits.bitwiseAND(F.lit(soft).cast("long"))) <= policy.most_soft)


def apply_policy(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The ledger with ``policy`` (its version) and ``kept``."""
    return ledger.withColumn("policy", F.lit(policy.version)).withColumn("kept", verdict(policy, rules))


def _patterns(ledger: DataFrame) -> DataFrame:
    """Documents and words by failure bits: summed before the shuffle, a row for each set of bits that occurs."""
    return ledger.groupBy("failures").agg(F.count(F.lit(1)).alias("docs"), F.sum("n_words").alias("words"))


def policy_report(ledger: DataFrame, policies: tuple[Policy, ...] = POLICIES, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """policy, docs, words, kept_docs, kept_words of each version, from one pass over the ledger."""
    each = F.explode(F.array(*[F.struct(F.lit(p.version).alias("policy"), verdict(p, rules).alias("kept")) for p in policies])).alias("p")
    rows = _patterns(ledger).select("docs", "words", each).select("docs", "words", "p.*")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.groupBy("policy").agg(total("docs").alias("docs"), total("words").alias("words"), total(F.when(F.col("kept"), F.col("docs"))).alias("kept_docs"), total(F.when(F.col("kept"), F.col("words"))).alias("kept_words"))


def ablations(ledger: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy: what fails it, and what would come back without it.

    rule, failed_docs, failed_words, regained_docs, regained_words. Sums are over sets of
    failure bits, of which there are few however many documents there are.
    """
    used = [(i, r.name) for i, r in enumerate(rules) if r.name in (*policy.hard, *policy.soft)]
    kept = verdict(policy, rules)
    each = [F.struct(F.lit(n).alias("rule"), (F.col("failures").bitwiseAND(F.lit(1 << i).cast("long")) != 0).alias("failed"), (~kept & verdict(policy, rules, without=1 << i)).alias("regained")) for i, n in used]
    rows = _patterns(ledger).select("docs", "words", F.explode(F.array(*each)).alias("r")).select("docs", "words", "r.*")
    total = lambda flag, c: F.coalesce(F.sum(F.when(F.col(flag), F.col(c))), F.lit(0)).cast("long").alias(f"{flag}_{c}")
    return rows.groupBy("rule").agg(*[total(f, c) for f in ("failed", "regained") for c in ("docs", "words")])
