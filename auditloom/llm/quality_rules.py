"""Rule bitmask ledger: every rule is evaluated once, its failure kept as one bit beside the measurements.

``ledger`` reads each text once and returns measurements and ``fail_bits``.  Policies are versioned sets
of rules: ``apply_policy`` decides by one bitwise AND, and ``ablations`` counts, in one aggregation over
the bits, what each rule of a policy rejects, rejects alone, and would release if it were dropped.

Defined cases: a null text has no word, like an empty one; a very long text is read whole, a block of its
own; repeated rows are measured row by row; a measurement equal to a rule's limit (a tie) passes the rule; an
empty table gives empty results; other columns are carried along when named in ``keep``; a column of the
input that bears a measurement's name is not read and not returned unless kept under that name, which is
an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.llm.text_blocks import Block, classes, mix, ngrams

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_caps", "n_letters")
WINDOW = 8
_WORDS, _LINES = classes(), classes(b"\n")
_TABLES = {name: np.isin(np.arange(256), list(chars)) for name, chars in {"symbols": b"#*$%&|<>", "caps": bytes(range(65, 91)), "letters": bytes([*range(65, 91), *range(97, 123), *range(128, 192)])}.items()}


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``failed`` (SQL over the measurements) holds; ``bit`` is its place in the ledger."""

    name: str
    bit: int
    failed: str


RULES = (
    Rule("few_words", 0, "n_words < 20"),
    Rule("repeated_windows", 1, "100 * n_repeat_words > 30 * n_words"),
    Rule("symbol_heavy", 2, "100 * n_symbols > 10 * n_words"),
    Rule("duplicate_lines", 3, "100 * n_dup_lines > 50 * n_lines"),
    Rule("odd_word_length", 4, "word_chars < 2 * n_words or word_chars > 20 * n_words"),
    Rule("shouting", 5, "n_letters > 0 and 100 * n_caps > 60 * n_letters"),
)


@dataclass(frozen=True)
class Policy:
    """A version and the names of the rules that reject."""

    version: str
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        bits = {r.name: r.bit for r in RULES}
        return sum(1 << bits[name] for name in self.rules)


BASE = Policy("base", ("few_words", "repeated_windows"))
STRICT = Policy("v1", tuple(r.name for r in RULES))


def _repeats(keys: np.ndarray) -> np.ndarray:
    """Which keys occur twice or more; and first of all, in ``later``, which are not the first of their kind."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    flags = np.zeros((2, len(keys)), bool)
    flags[0, order[1:][same]] = flags[0, order[:-1][same]] = True
    flags[1, order[1:][same]] = True
    return flags


def measure(block: Block) -> dict[str, np.ndarray]:
    """The measurements of every text of a block."""
    n = len(block.offsets) - 1
    words, lines = block.tokens(_WORDS), block.tokens(_LINES)

    def per_text(flag: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
        return sums[block.offsets[1:]] - sums[block.offsets[:-1]]

    leads = (block.data & 0xC0) != 0x80
    in_word = _WORDS.of[block.data] != 0
    salt = mix(np.arange(1, n + 1, dtype=np.uint64))
    of_line, of_word = lines.owner(), words.owner()
    worded = np.searchsorted(words.starts, lines.ends) > np.searchsorted(words.starts, lines.starts)
    later = _repeats(mix(lines.hashes[worded] + salt[of_line[worded]]))[1]
    at = np.flatnonzero(of_word[: max(0, len(of_word) - WINDOW + 1)] == of_word[WINDOW - 1 :])
    window = ngrams(words.hashes, tuple(range(1, WINDOW)), 8)[at]
    twice = at[_repeats(mix(window + salt[of_word[at]]))[0]]
    cover = np.zeros(len(of_word) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + WINDOW, -1)
    return {
        "n_words": np.diff(words.offsets),
        "word_chars": per_text(leads & in_word),
        "n_symbols": per_text(_TABLES["symbols"][block.data]),
        "n_dup_lines": np.bincount(of_line[worded][later], minlength=n),
        "n_repeat_words": np.bincount(of_word[np.cumsum(cover[:-1]) > 0], minlength=n),
        "n_lines": np.bincount(of_line[worded], minlength=n),
        "n_caps": per_text(_TABLES["caps"][block.data]),
        "n_letters": per_text(_TABLES["letters"][block.data]),
    }


def fail_bits(rules: Sequence[Rule] = RULES) -> Column:
    total = F.lit(0).cast("long")
    for rule in rules:
        total = total + F.when(F.expr(rule.failed), F.lit(1 << rule.bit)).otherwise(F.lit(0)).cast("long")
    return total


def ledger(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), rules: Sequence[Rule] = RULES) -> DataFrame:
    """``keep`` columns, the measurements and ``fail_bits``, a row for each row of ``docs``; no shuffle."""
    from auditloom.llm.arrow_map import add_columns

    def run(block: Block) -> list[pa.Array]:
        found = measure(block)
        return [pa.array(found[name].astype(np.int64)) for name in MEASURES]

    return add_columns(docs, text, run, ", ".join(f"{m} long" for m in MEASURES), keep).withColumn("fail_bits", fail_bits(rules))


def rejected(policy: Policy) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long")) != 0


def apply_policy(kept_ledger: DataFrame, policy: Policy, name: str = "kept") -> DataFrame:
    """The ledger with the policy's verdict; texts are not read again."""
    return kept_ledger.withColumn(name, ~rejected(policy))


def ablations(kept_ledger: DataFrame, policies: Sequence[Policy]) -> DataFrame:
    """A row a policy and rule: documents it rejects, rejects alone (what dropping it would release), and the policy's total."""
    sums = [F.count(F.lit(1)).alias("n_docs")]
    bits = {r.name: 1 << r.bit for r in RULES}
    for i, policy in enumerate(policies):
        hit = F.col("fail_bits").bitwiseAND(F.lit(policy.mask).cast("long"))
        sums.append(F.count_if(hit != 0).alias(f"p{i}"))
        for j, rule in enumerate(policy.rules):
            sums += [F.count_if(hit.bitwiseAND(F.lit(bits[rule]).cast("long")) != 0).alias(f"p{i}r{j}"), F.count_if(hit == bits[rule]).alias(f"p{i}a{j}")]
    rows = [F.struct(F.lit(p.version).alias("version"), F.lit(rule).alias("rule"), F.col("n_docs"), F.col(f"p{i}").alias("rejected"), F.col(f"p{i}r{j}").alias("rejected_by_rule"), F.col(f"p{i}a{j}").alias("rejected_by_rule_alone")) for i, p in enumerate(policies) for j, rule in enumerate(p.rules)]
    return kept_ledger.agg(*sums).select(F.explode(F.array(*rows)).alias("row")).select("row.*")


def op2_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The strict policy's verdict on every whole text of ``documents``."""
    found = ledger(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = apply_policy(apply_policy(found, BASE, "base_kept"), STRICT)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~F.col("base_kept")).alias("base_failed"), "kept", "fail_bits")


OP2_SQL = r"""
with w as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
lines as (select doc_id, l, count(*) as c from (select doc_id, unnest(string_split(t, chr(10))) as l from w) where regexp_matches(l, '[^\x20\x09-\x0D]') group by 1, 2),
dup as (select doc_id, sum(c - 1)::bigint as n_dup_lines, sum(c)::bigint as n_lines from lines group by 1),
win as (select doc_id, i, array_to_string(words[i:i + 7], ' ') as g from (select doc_id, words, unnest(range(1, len(words) - 6)) as i from w where len(words) >= 8)),
twice as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as c from win) where c > 1),
rep as (select doc_id, count(distinct i + o)::bigint as n_repeat_words from twice, range(8) as r(o) group by 1),
m as (select w.doc_id, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
  coalesce(n_lines, 0) as n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) as n_caps,
  length(regexp_replace(t, '[^A-Za-z]', '', 'g')) + octet_length(encode(t)) - length(t) as n_letters
  from w left join dup using (doc_id) left join rep using (doc_id)),
b as (select *, (n_words < 20)::bigint + 2 * (100 * n_repeat_words > 30 * n_words)::bigint + 4 * (100 * n_symbols > 10 * n_words)::bigint
  + 8 * (100 * n_dup_lines > 50 * n_lines)::bigint + 16 * (word_chars < 2 * n_words or word_chars > 20 * n_words)::bigint
  + 32 * (n_letters > 0 and 100 * n_caps > 60 * n_letters)::bigint as fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 as base_failed, fail_bits = 0 as kept, fail_bits from b
"""
