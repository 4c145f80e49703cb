"""Quality rules as a ledger of failure bits, with policies applied to the bits afterwards.

Each rule is evaluated once per document from measurements; its verdict is one bit.  A policy
is a named, versioned mask of bits that reject.  Changing a policy or asking what a rule
alone removes touches the ledger only, never the texts; the ledger can be stored and read
again.  All of it is SQL functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm import _kit

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
BLANKS = "".join(map(chr, _kit.SPACES))


@dataclass(frozen=True)
class Rule:
    """bit: its place in the mask; fails: a condition on the measurements."""

    name: str
    bit: int
    fails: str


#: Rules at their production thresholds; a bit is never given to another rule.
RULES = (
    Rule("few_words", 0, "n_words < 10"),
    Rule("repeated_words", 1, "100 * n_repeat_words > 20 * n_words"),
    Rule("symbols", 2, "10 * n_symbols > 3 * word_chars"),
    Rule("repeated_lines", 3, "n_lines >= 4 and 10 * n_dup_lines > 7 * n_lines"),
    Rule("long_words", 4, "n_words > 0 and word_chars > 40 * n_words"),
    Rule("many_words", 5, "n_words > 1000000"),
)


@dataclass(frozen=True)
class Policy:
    """The rules that reject a document, by name."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        bits = {r.name: r.bit for r in rules}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
STANDARD = Policy("standard", 1, ("few_words", "repeated_words", "symbols", "repeated_lines", "long_words"))


def _repeated(found: str) -> str:
    """SQL: places whose value comes up twice or more, in order, from an array of structs (value h, place i)."""
    near = "zip_with(slice(s, 1, size(s) - 1), slice(s, 2, size(s) - 1), (x, y) -> if(x.h = y.h, array(x.i, y.i), cast(array() as array<int>)))"
    return f"array_sort(array_distinct(flatten(flatten(transform(array(array_sort({found})), s -> if(size(s) < 2, cast(array() as array<array<int>>), {near}))))))"


def _covered(places: str, width: int) -> str:
    """SQL: how many words windows at these places, in order, cover: each adds what lies beyond the one before."""
    return f"cast(aggregate({places}, struct(0L as n, 0 as next), (a, i) -> struct(a.n + (i + {width} - greatest(i, a.next)) as n, i + {width} as next), a -> a.n) as bigint)"


def measurements(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) per row.

    Windows are compared by hash first; where hashes repeat, the windows themselves are.
    """
    text = docs.select(F.col(id_col).alias("id"), _kit.text_of(text_col).alias("text"))
    worded = text.select(
        "id",
        F.regexp_extract_all("text", F.lit(f"({_kit.WORD})"), F.lit(1)).alias("w"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.filter(F.split("text", "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0).alias("lines"),
    )
    count = f"greatest(size(w) - {width - 1}, 0)"
    parts = ", ".join(f"slice(w, {i + 1}, {count})" for i in range(width))
    hashed = worded.select(
        "*",
        F.size("w").cast("long").alias("n_words"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(f"transform(arrays_zip({parts}), x -> xxhash64(x))").alias("h"),
    )
    # places whose hashes repeat are few; only their windows are built and compared
    alike = _repeated("zip_with(h, sequence(0, size(h) - 1), (h, i) -> struct(h, i))")
    exact = f"transform({alike}, i -> struct(array_join(slice(w, i + 1, {width}), ' ') as h, i as i))"
    repeat = F.expr(f"if(size(array_distinct(h)) = size(h), 0L, {_covered(_repeated(exact), width)})")
    return hashed.select("id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", repeat.alias("n_repeat_words"))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: id_col, the measurements, and failed, a mask of the rules that fail.

    A null text has no words.  Empty texts measure 0 throughout.  Null and repeated ids stay
    as they are; texts may be of any length that a row can have.  Other columns are ignored; an
    empty table gives an empty result.
    """
    bits: Column = F.lit(0).cast("long")
    for rule in rules:
        bits = bits.bitwiseOR(F.when(F.expr(rule.fails), F.lit(1 << rule.bit).cast("long")).otherwise(F.lit(0).cast("long")))
    return measurements(docs, id_col, text_col).withColumn("failed", bits).withColumnRenamed("id", id_col)


def kept_by(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a ledger's row passes the policy."""
    return F.col("failed").bitwiseAND(F.lit(policy.mask(rules))) == 0


def ablation(found: DataFrame, policy: Policy, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each rule of a policy, over a ledger: documents it fails, those it alone rejects, and
    those the policy would keep without it.  One pass; each task sends one row of sums."""
    mask, failed = policy.mask(rules), F.col("failed")
    chosen = [r for r in rules if r.name in policy.rules]
    one = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")
    sums = [F.count("*").alias("documents")]
    for r in chosen:
        bit = 1 << r.bit
        sums.append(F.struct(F.lit(r.name).alias("rule"), one(failed.bitwiseAND(bit) != 0).alias("fails"), one(failed.bitwiseAND(mask) == bit).alias("alone"), one(failed.bitwiseAND(mask & ~bit) == 0).alias("kept_without")).alias(f"r{r.bit}"))
    return found.agg(*sums).select("documents", F.explode(F.array(*(f"r{r.bit}" for r in chosen))).alias("r")).select(F.lit(f"{policy.name}-{policy.version}").alias("policy"), "r.*", "documents")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: Policy = STANDARD) -> DataFrame:
    """The ledger with base_failed and kept, the verdict of the policy together with the base rules."""
    found = ledger(docs, id_col, text_col)
    return found.select("*", (~kept_by(BASE)).alias("base_failed"), (kept_by(BASE) & kept_by(policy)).alias("kept"))
