"""Host-level quality rules (operator 5): DataFrame functions only.

Rules judge documents; failures are summed by host, each host's failure rate is shrunk towards the corpus by a
beta prior fitted to the hosts themselves (method of moments), which also says how high a rate is out of the ordinary,
and the verdict on the host joins back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, stash

# The white space that ends words, as a pattern and as characters; the symbols that count as junk.
BLANKS, BLANK_CHARS = r"[\x20\x09-\x0D]+", " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, BLANKS), lambda w: w != "")


def repeat_words(words: Column) -> Column:
    """How many words stand in a three-word window that the text has twice or more (sorted windows, neighbours compared)."""

    def marked(s: Column) -> Column:
        twins = F.filter(F.sequence(F.lit(1), F.size(s) - 1), lambda k: s[k]["g"] == s[k - 1]["g"])
        places = F.transform(twins, lambda k: F.array(s[k - 1]["i"], s[k]["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(F.array_distinct(F.flatten(places)), lambda i: F.array(i, i + 1, i + 2)))))

    def counted(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.concat_ws(" ", w[i], w[i + 1], w[i + 2]))

        def judged(g: Column) -> Column:
            sorted_ = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))
            return F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(let(sorted_, marked))

        return F.when(F.size(w) < 4, F.lit(0)).otherwise(let(grams, judged))

    return let(words, counted)


def document_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document the counts the rules use, and base_failed and failed (any rule).

    Rules: fewer than 50 words; over half of the words in repeated windows; symbols over a tenth of the word
    characters; over three tenths of the lines repeated.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lined = F.filter(F.split(F.col("t"), "\n"), lambda x: F.length(F.translate(x, BLANK_CHARS, "")) > 0)
    counts = (
        docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(host), F.lit("")).alias("host"), body.alias("t"))
        .withColumn("w", words_of(F.col("t")))
        .select(
            "doc_id",
            "host",
            F.size("w").cast("long").alias("n_words"),
            F.length(F.translate("t", BLANK_CHARS, "")).cast("long").alias("word_chars"),
            (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
            let(lined, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("again"))).alias("lines"),
            repeat_words(F.col("w")).cast("long").alias("n_repeat_words"),
        )
        .select("doc_id", "host", "n_words", "word_chars", "n_symbols", F.col("lines.again").alias("n_dup_lines"), "n_repeat_words", F.col("lines.all").alias("n_lines"))
    )
    base = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    more = F.expr("10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines")
    return counts.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | more)


def host_verdicts(rules: DataFrame) -> DataFrame:
    """Per host: n_docs, n_failed, rate (shrunk) and host_rejected.

    The prior is a beta distribution with the mean and variance of the hosts' rates (each host weighs as its documents do,
    50 at most, so that a host of a third of all rows does not set it; the variance is less what chance adds to it), of a
    weight of 1 to 1000 documents. A host is rejected if its rate is surely too high: the posterior mean less two
    standard deviations is over twice the prior's mean and over its mean plus three standard deviations, or over two thirds.
    """
    hosts = rules.groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    w, rate = F.least("n_docs", F.lit(50)).cast("double"), F.col("n_failed").cast("double") / F.col("n_docs")
    prior = (
        hosts.agg(F.sum(w).alias("w"), F.sum(w * rate).alias("wr"), F.sum(w * rate * rate).alias("wrr"), F.sum(w / F.col("n_docs")).alias("wn"))
        .withColumn("mean", F.expr("wr / w"))
        .withColumn("variance", F.expr("wrr / w - mean * mean - mean * (1 - mean) * wn / w"))
        .withColumn("weight", F.expr("case when variance > 0 then least(1000d, greatest(1d, mean * (1 - mean) / variance - 1)) else 1000d end"))
        .select("mean", "weight", F.expr("least(2d / 3, greatest(2 * mean, mean + 3 * sqrt(mean * (1 - mean) / (weight + 1))))").alias("most"))
    )
    shrunk = hosts.crossJoin(F.broadcast(prior)).withColumn("rate", F.expr("(n_failed + mean * weight) / (n_docs + weight)"))
    return shrunk.select("host", "n_docs", "n_failed", "rate", F.expr("rate - 2 * sqrt(rate * (1 - rate) / (n_docs + weight + 1)) > most").alias("host_rejected"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source") -> DataFrame:
    """Per document: key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, host, host_rate.

    kept is false if the base rules fail the document or its host is rejected, whose rate counts failures of any rule.
    Null texts count as empty (and fail), null hosts as "". Repeated rows are judged each by itself, whatever their key;
    other columns of docs are ignored; the key may be of any type. The counts are worked out once and written to the
    shared folder; hosts are summed before they are shuffled, and their verdicts are written too, so that Spark knows
    their size: it broadcasts them while they are small and else splits a hot host's rows in the join.
    """
    rules = stash(document_rules(docs, key, text, host), "rules")
    verdicts = stash(host_verdicts(rules).select("host", "rate", "host_rejected"), "hosts")
    return rules.join(verdicts, "host", "left").select(
        F.col("doc_id").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "host", F.round("rate", 9).alias("host_rate"),
    )


#: The same in DuckDB's SQL, over the table documents.
QUALITY_SQL = r"""
with t as (
  select doc_id, coalesce(source, '') as host, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
  from documents),
g as (
  select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g
  from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from t where len(w) >= 3)),
d as (select doc_id, i, count(*) over (partition by doc_id, g) as c from g),
r as (select doc_id, count(distinct i + k) as n from d, (values (0), (1), (2)) v(k) where c > 1 group by doc_id),
m as (
  select t.doc_id, host, len(w)::bigint as n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines,
         coalesce(r.n, 0)::bigint as n_repeat_words, len(ls) as n_lines
  from t left join r on t.doc_id = r.doc_id),
f as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
         10 * n_symbols > word_chars or 10 * n_dup_lines > 3 * n_lines as more from m),
h as (select host, count(*) as n, sum((base_failed or more)::bigint) as bad, least(count(*), 50)::double as w, sum((base_failed or more)::bigint)::double / count(*) as r from f group by host),
p as (select sum(w * r) / sum(w) as mean, sum(w * r * r) / sum(w) as squares, sum(w / n) / sum(w) as wn from h),
v as (select mean, squares - mean * mean - mean * (1 - mean) * wn as variance from p),
q as (select mean, case when variance > 0 then least(1000, greatest(1, mean * (1 - mean) / variance - 1)) else 1000 end as weight from v),
m2 as (select mean, weight, least(2.0 / 3, greatest(2 * mean, mean + 3 * sqrt(mean * (1 - mean) / (weight + 1)))) as most from q),
k as (select host, n, weight, most, (bad + mean * weight) / (n + weight) as rate from h, m2)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not (rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1)) > most) as kept, host, round(rate, 9) as host_rate
from f join k using (host)
"""
