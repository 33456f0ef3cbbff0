"""Quality rules as a bitmask ledger.

`ledger` measures every document once and stores, per document, all measurements and one bit for
each rule that failed. Policies are named, versioned masks over those bits: applying another policy,
or computing what each rule alone removes, reads the ledger and never the texts.

Nulls: a null text has no words and fails the length rule. Empty texts likewise. Repeated rows
and ties need no care, each row is judged on its own. Extra columns are kept out of the ledger.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_text, words_sql

# Frequent function words of four languages, and plain insults.
STOP_WORDS = (
    "the of and to in is that it for was with on as be at by this are from or an not have "
    "de la le les et des en un une du que qui dans pour par sur pas au est "
    "der die das und von zu mit den ist im ein eine nicht sich auf für auch "
    "el los las y del se con por una su para es lo no"
).split()
TOXIC_WORDS = "trash pathetic idiot disgusting worthless stupid clown loser scum moron".split()


@dataclass(frozen=True)
class Rule:
    """`fails` is SQL over the measurements; its position in RULES is its bit."""

    name: str
    fails: str


RULES = (
    Rule("few_words", "n_words < 50"),
    Rule("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    Rule("symbols", "10 * n_symbols > n_words"),
    Rule("repeated_lines", "100 * n_dup_lines > 40 * n_lines"),
    Rule("long_words", "word_chars > 10 * n_words"),
    Rule("short_words", "word_chars < 3 * n_words"),
    Rule("capitals", "5 * n_capitals > word_chars"),
    Rule("digits", "5 * n_digits > word_chars"),
    Rule("no_function_words", "100 * n_stop_words < 3 * n_words"),
    Rule("few_distinct_words", "20 * n_distinct_words < n_words"),
    Rule("toxic_words", "200 * n_toxic_words >= n_words AND n_toxic_words > 0"),
)
BIT = {rule.name: 1 << i for i, rule in enumerate(RULES)}
ALL_BITS = (1 << len(RULES)) - 1

#: Version -> mask of the rules that reject.
POLICIES = {
    "base-1": BIT["few_words"] | BIT["repeated_words"],
    "quality-1": ALL_BITS & ~BIT["toxic_words"],
    "quality-2": ALL_BITS,
}

MEASURES = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
    "n_capitals", "n_digits", "n_stop_words", "n_toxic_words", "n_distinct_words",
)


_MARKS = ".,;:!?\"()#*$%&|"
#: Most labelled rows that a lexicon is fitted on.
LEXICON_ROWS = 20_000


def _among(words: Sequence[str]) -> str:
    return ", ".join("'{}'".format(w.replace("\\", "\\\\").replace("'", "\\'")) for w in sorted({*words}))


def _plain(word: str) -> str:
    return f"trim(BOTH '{_MARKS}' FROM lower({word}))"


def fit_lexicon(docs: DataFrame, labels: DataFrame, rows: int = LEXICON_ROWS, least: int = 5) -> list[str]:
    """Words that mark toxic documents: in `least` or more of the toxic ones, which are at least 19 of 20 that have it.

    Fitted on at most `rows` labels (doc_id, toxic), those of least md5, so that the broadcast and the result are bounded.
    """
    sample = labels.where("toxic IS NOT NULL").select(F.col("doc_id").alias("labelled"), F.col("toxic").cast("int").alias("toxic")).distinct()
    sample = sample.orderBy(F.md5(F.col("labelled").cast("string")), "toxic").limit(rows)
    texts = id_text(docs).join(F.broadcast(sample), F.col("doc_id") == F.col("labelled"))
    plain = F.expr(f"array_distinct(transform({words_sql('text')}, w -> {_plain('w')}))")
    counts = texts.select("toxic", F.explode(plain).alias("w")).groupBy("w").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n"))
    found = counts.where((F.col("bad") >= least) & (20 * F.col("bad") >= 19 * F.col("n")) & (F.length("w") >= 3))
    return sorted(r.w for r in found.select("w").collect())


def measure(docs: DataFrame, lexicon: Sequence[str] = ()) -> DataFrame:
    """(doc_id, measurements) of each whole text, by built-in expressions only. `lexicon` adds to the plain insults.

    What can be skipped is: only a text with two equal hashes of 3-word windows has its windows compared as text,
    and characters are counted in what one regular expression finds in the text.
    """
    toxic = [*TOXIC_WORDS, *lexicon]
    rows = id_text(docs).select(
        "doc_id",
        F.expr(words_sql("text")).alias("words"),
        F.expr(r"filter(split(text, '\n'), l -> l rlike '[^\\x20\\x09-\\x0D]')").alias("lines"),
        # Found, not left over by replacing the rest of the text, which takes ten times as long.
        F.expr("array_join(regexp_extract_all(text, '[A-Z0-9#*$%&|<>]+', 0), '')").alias("marks"),
    )
    pairs = "zip_with(words, slice(words, 2, size(words)), (a, b) -> {})"
    third = "slice(words, 3, greatest(size(words) - 2, 0))"
    rows = rows.select(
        "*",
        F.expr(f"""zip_with(slice({pairs.format("xxhash64(a, b)")}, 1, greatest(size(words) - 2, 0)), {third},
            (h, c) -> xxhash64(h, c))""").alias("hashes"),
        F.expr(f"filter(transform(words, w -> {_plain('w')}), w -> w IN ({_among([*STOP_WORDS, *toxic])}))").alias("listed"),
    )
    # Windows with their positions, sorted by content: equal ones are neighbours. Only where hashes repeat.
    rows = rows.select(
        "*",
        F.expr(f"""IF(size(array_distinct(hashes)) = size(hashes), NULL, sort_array(zip_with(
            zip_with(slice({pairs.format("concat(a, ' ', b)")}, 1, greatest(size(words) - 2, 0)), {third}, (ab, c) -> concat(ab, ' ', c)),
            sequence(0, size(words) - 3), (w, i) -> struct(w, i))))""").alias("windows"),
    )
    rows = rows.select(
        "*",
        F.expr("""array_distinct(sort_array(flatten(zip_with(windows, slice(windows, 2, size(windows)),
            (a, b) -> IF(a.w = b.w, array(a.i, b.i), array())))))""").alias("repeated"),
    )
    # Sorted starts: each covers three words, or less where the next one starts within them.
    covered = """CASE WHEN repeated IS NULL OR size(repeated) = 0 THEN 0 ELSE 3 + aggregate(
        zip_with(slice(repeated, 2, size(repeated)), slice(repeated, 1, size(repeated) - 1), (b, a) -> least(3, b - a)),
        0L, (s, x) -> s + x) END"""
    return rows.select(
        "doc_id",
        *(
            F.expr(e).cast("long").alias(name)
            for name, e in {
                "n_words": "size(words)",
                "word_chars": "length(array_join(words, ''))",
                "n_symbols": "length(regexp_replace(marks, '[A-Z0-9]+', ''))",
                "n_lines": "size(lines)",
                "n_dup_lines": "size(lines) - size(array_distinct(lines))",
                "n_repeat_words": covered,
                "n_capitals": "length(regexp_replace(marks, '[^A-Z]+', ''))",
                "n_digits": "length(regexp_replace(marks, '[^0-9]+', ''))",
                "n_stop_words": f"size(filter(listed, w -> w IN ({_among(STOP_WORDS)})))",
                "n_toxic_words": f"size(filter(listed, w -> w IN ({_among(toxic)})))",
                "n_distinct_words": "size(array_distinct(words))",
            }.items()
        ),
    )


def failure_bits() -> Column:
    return F.expr(" | ".join(f"IF({r.fails}, {1 << i}L, 0L)" for i, r in enumerate(RULES)))


def ledger(docs: DataFrame, lexicon: Sequence[str] = ()) -> DataFrame:
    """(doc_id, measurements, fail_bits): every rule evaluated once for each document."""
    return measure(docs, lexicon).withColumn("fail_bits", failure_bits())


def apply_policy(entries: DataFrame, policy: str = "quality-2") -> DataFrame:
    """The ledger with `kept`: no rule of the policy's mask failed."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(POLICIES[policy])) == 0)


def ablation(entries: DataFrame, policy: str = "quality-2") -> DataFrame:
    """What each rule of a policy removes: (policy, rule, n_failed, n_failed_alone, n_kept, n_kept_without).

    The ledger shrinks to one row for each distinct bit pattern (at most 2^rules) before any rule is looked at.
    """
    mask = POLICIES[policy]
    patterns = entries.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask)).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(
        F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).alias("bit")) for r in RULES if BIT[r.name] & mask))
    )
    some = patterns.select("bits", "n", rules.alias("r")).select("bits", "n", "r.rule", F.col("r.bit").cast("long").alias("bit"))
    count = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0)).cast("long")
    return some.groupBy("rule").agg(
        F.lit(policy).alias("policy"),
        count(F.col("bits").bitwiseAND(F.col("bit")) != 0).alias("n_failed"),
        count(F.col("bits") == F.col("bit")).alias("n_failed_alone"),
        count(F.col("bits") == 0).alias("n_kept"),
        count((F.col("bits") == 0) | (F.col("bits") == F.col("bit"))).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: str = "quality-2", lexicon: Sequence[str] = ()) -> DataFrame:
    """The rows of `docs` (all columns) that the policy keeps.

    The verdict of a text is joined to nothing: it is computed beside the row, so repeated or null ids do no harm.
    """
    names = docs.columns
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("doc_id"), "text")
    # An explode, not a filter: the planner would copy all measurements into a filter on them, each as often as it is used.
    judged = apply_policy(ledger(whole, lexicon), policy)
    kept = judged.select(F.explode(F.when(F.col("kept"), F.array("doc_id"))).alias("doc_id"))
    return kept.select(*(F.col("doc_id").getField(c).alias(c) for c in names))
