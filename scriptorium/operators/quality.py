"""Text features and quality scores of documents: one scan, no shuffle, except where a profile is grouped."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import text as T
from ..sources.tables import table
from . import kernels

text = "text"


def corpus_profile(docs: DataFrame) -> DataFrame:
    """Size, vocabulary and duplicate share of each language."""
    rows = docs.select("lang", "source", "n_chars", F.size(T.words(text)).alias("n_words"), F.sha2("text", 256).alias("sha"))
    return rows.groupBy("lang").agg(
        F.count("*").alias("n_docs"),
        F.sum("n_chars").alias("chars"),
        F.sum("n_words").alias("words"),
        F.countDistinct("source").alias("sources"),
        F.round(1 - F.countDistinct("sha") / F.count("*"), 6).alias("duplicate_ratio"),
    )


def word_stats(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.length("text").alias("length"), T.words(text).alias("w"), F.size(T.sentences(text)).alias("n_sentences"))
    n, distinct = F.size("w"), F.size(F.array_distinct("w"))
    return rows.select("doc_id", n.alias("n_words"), distinct.alias("n_distinct"), "n_sentences", F.round(T.ratio(distinct, n), 6).alias("type_token_ratio"), F.greatest(F.lit(1), F.expr("cast(length div 4 as int)")).alias("est_tokens"))


def readability(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.round(T.flesch(text), 4).alias("flesch"))


def readability_oscillation(docs: DataFrame, window: int = 5) -> DataFrame:
    """Population deviation of reading ease over runs of ``window`` sentences."""
    s = docs.select("doc_id", F.posexplode(T.sentences(text)).alias("pos", "sentence"))
    runs = s.groupBy("doc_id", F.floor(F.col("pos") / window).alias("run")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ").alias("part"))
    eased = runs.select("doc_id", T.flesch(F.col("part")).alias("ease"))
    return eased.groupBy("doc_id").agg(F.count("*").alias("n_runs"), F.round(F.stddev_pop("ease"), 4).alias("oscillation"))


def ngram_entropy(docs: DataFrame) -> DataFrame:
    """Normalised bigram and trigram entropy, repetition, and the blended score: counted text by text, without a shuffle."""
    names = ("bigram_entropy", "trigram_entropy", "top_share", "repeated_bigrams")
    counted = docs.select("doc_id", "text").mapInArrow(kernels.ngram_statistics, "doc_id long, " + ", ".join(f"{n} double" for n in names) + ", more_bigrams double")
    repetition = T.clamp(0.6 * F.col("top_share") + 0.4 * F.col("repeated_bigrams"))
    entropy = (F.col("bigram_entropy") + F.col("trigram_entropy")) / 2
    score = T.clamp(0.7 * T.clamp(1 - entropy) + 0.3 * repetition)
    return counted.where("top_share > 0").select("doc_id", F.round("bigram_entropy", 6).alias("bigram_entropy"), F.round("trigram_entropy", 6).alias("trigram_entropy"), F.round(repetition, 6).alias("repetition"), F.round(score, 6).alias("score"))


def repetition_signals(docs: DataFrame) -> DataFrame:
    """Share of repeated 5-grams and of repeated sentence beginnings."""
    # The words are a column of their own: within a lambda the expression would be worked out for every element.
    split = docs.select("doc_id", T.words(text).alias("w"), F.transform(T.sentences(text), lambda s: F.substring_index(F.lower(s), " ", 1)).alias("s"))
    grams = split.select("doc_id", T.ngrams(F.col("w"), 5).alias("g"), "s")
    share = lambda c: F.round(F.when(F.size(c) > 0, (F.size(c) - F.size(F.array_distinct(c))) / F.size(c)).otherwise(0.0), 6)
    return grams.select("doc_id", share(F.col("g")).alias("repeated_5grams"), share(F.col("s")).alias("repeated_starts"))


def chunk_quality(docs: DataFrame) -> DataFrame:
    """Blend of length, letters, symbols and repeated lines, its grade, and whether the chunk passes the gate."""
    cleaned = T.strip(text)
    compact = F.regexp_replace(cleaned, r"\s+", "")
    lines = F.filter(F.transform(F.split(cleaned, "\n"), T.strip), lambda x: x != "")
    size = F.length(compact)
    rows = docs.select("doc_id", F.length(cleaned).alias("length"), (T.count(compact, "[A-Za-z]") / size).alias("alpha"), (T.count(compact, r"[^\w]") / size).alias("symbol"), (1 - F.size(F.array_distinct(lines)) / F.size(lines)).alias("repeat"))
    quality = F.round(T.clamp(0.4 * F.least(F.lit(1.0), F.col("length") / 150) + 0.3 * F.col("alpha") + 0.2 * (1 - F.col("symbol")) + 0.1 * (1 - F.col("repeat"))), 3)
    scored = rows.select("doc_id", F.round("alpha", 6).alias("alpha_ratio"), F.round("symbol", 6).alias("symbol_ratio"), F.round("repeat", 6).alias("repeat_ratio"), quality.alias("quality"), "length")
    keep = (F.col("length") >= 40) & (F.col("quality") >= 0.2) & (F.col("symbol_ratio") <= 0.6)
    return scored.select("doc_id", "alpha_ratio", "symbol_ratio", "repeat_ratio", "quality", T.grade(F.col("quality")).alias("grade"), keep.alias("kept"))


def text_quality(docs: DataFrame) -> DataFrame:
    """Encoding cleanliness, closeness of word length to 5 and of sentence length to 18, on a scale to 20."""
    w = docs.select("doc_id", "text", T.words(text).alias("w"), F.size(T.sentences(text)).alias("s"))
    n = F.greatest(F.size("w"), F.lit(1))
    broken = T.count(text, "[\x00�]") / F.greatest(F.length("text"), F.lit(1))
    word_length = T.total(F.col("w"), F.length) / n
    sentence_length = F.size("w") / F.greatest(F.col("s"), F.lit(1))
    near = lambda c, best: T.clamp(1 - F.abs(c - best) / best)
    score = F.round(20 * (0.4 * (1 - broken) + 0.3 * near(word_length, 5) + 0.3 * near(sentence_length, 18)), 2)
    return w.select("doc_id", score.alias("score"), T.grade100(score * 5).alias("grade"))


def authorship(docs: DataFrame) -> DataFrame:
    """Additive signals of machine-made text: low bigram entropy, repeated phrasing, even sentences, sparse punctuation."""
    def counted(frames):
        for batch in frames:
            stats = kernels.ngram_counts(batch.column("text"))
            extra = [pa.array([x["entropy"][2] for x in stats], pa.float64()), pa.array([x["more_bigrams"] for x in stats], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "entropy", "repeated"])

    base = docs.select("doc_id", "text").mapInArrow(counted, "doc_id long, text string, entropy double, repeated double")
    lengths = F.transform("s", lambda x: F.size(T.words(x)).cast("double"))
    rows = base.select("doc_id", "entropy", "repeated", T.words(text).alias("w"), T.sentences(text).alias("s"), T.count(text, "[.,;:!?]").alias("marks"))
    rows = rows.select("doc_id", "entropy", "repeated", (F.col("marks") / F.greatest(F.size("w"), F.lit(1))).alias("punctuation"), lengths.alias("lengths"))
    k, first, second = F.size("lengths"), T.total(F.col("lengths"), lambda x: x), T.total(F.col("lengths"), lambda x: x * x)
    deviation = F.sqrt(F.greatest(F.lit(0.0), second - first * first / k) / (k - 1))
    cv = F.when((k > 1) & (first != 0), deviation / (first / k)).otherwise(0.0)
    joined = rows.withColumns({"cv": cv, "k": k})
    score = T.clamp(
        F.when(F.col("entropy") < 0.55, (0.55 - F.col("entropy")) * 0.8).otherwise(0.0)
        + F.when(F.col("repeated") > 0.25, F.least(F.lit(0.4), F.col("repeated"))).otherwise(0.0)
        + F.when((F.col("cv") < 0.35) & (F.col("k") > 3), 0.25).otherwise(0.0)
        + F.when(F.col("punctuation") < 0.03, 0.1).otherwise(0.0)
    )
    return joined.select("doc_id", F.round("entropy", 6).alias("entropy"), F.round("repeated", 6).alias("repeated"), F.round("cv", 6).alias("length_cv"), F.round("punctuation", 6).alias("punctuation"), F.round(score, 6).alias("score"))


def hedging_and_voice(docs: DataFrame) -> DataFrame:
    """Density of hedging words, share of passive constructions, citations and malformed URLs."""
    rows = docs.select("doc_id", "text", T.words(text).alias("w"), F.size(T.sentences(text)).alias("s"))
    hedges = F.size(F.filter("w", lambda x: x.isin(*T.HEDGES)))
    dois, urls = T.count(text, T.ascii_edges(T.DOI)), F.regexp_extract_all(text, F.lit(T.URL), F.lit(0))
    bad = F.size(F.filter(urls, lambda u: F.contains(u, F.lit(".."))))
    citation = T.clamp(F.when(F.contains(F.lower(text), F.lit("doi")) & (dois == 0), 0.3).otherwise(0.0) + F.least(F.lit(0.7), 0.1 * bad))
    passive = T.count(text, T.ascii_edges(T.PASSIVE))
    return rows.select(
        "doc_id",
        F.round(T.clamp(T.ratio(hedges, F.size("w")) * 5), 6).alias("ambiguity"),
        passive.alias("passive_count"),
        F.round(T.clamp(T.ratio(passive, F.col("s"))), 6).alias("passive_ratio"),
        dois.alias("dois"),
        F.size(urls).alias("urls"),
        F.round(citation, 6).alias("citation_risk"),
    )


def text_hygiene(docs: DataFrame) -> DataFrame:
    """Normalised text digests, encoding garbage, validity as a chunk, and the letter-based language guess."""
    sample = F.substring(text, 1, 500)
    n = F.length(sample)
    garbage = (F.length("text") >= 20) & ((T.count(sample, "\x00") / n > 0.1) | (T.count(sample, "�") / n > 0.1) | ((n > 50) & (T.count(sample, r"[A-Za-z0-9\s]") / n < 0.3)))
    valid = (F.length(T.strip(text)) >= 40) & (T.count(text, r"\S+") >= 5) & (T.count(text, "[A-Za-z0-9]") / F.greatest(F.length("text"), F.lit(1)) >= 0.2)
    return docs.select("doc_id", F.md5(T.normalized(text)).alias("normal_md5"), F.md5(T.squeezed(text)).alias("squeezed_md5"), garbage.alias("garbage"), valid.alias("valid"), T.ascii_language(text).alias("language"))


def repeated_sentences_dropped(docs: DataFrame) -> DataFrame:
    """Texts of more than two sentences without repeats whose key is longer than 30 characters."""
    s = docs.select("doc_id", T.sentences(text).alias("s")).where(F.size("s") > 2).select("doc_id", F.posexplode("s").alias("pos", "sentence"))
    key = T.strip(F.regexp_replace(F.lower("sentence"), r"\s+", " "))
    keyed = s.withColumn("key", key).withColumn("seen", F.row_number().over(W.Window.partitionBy("doc_id", "key").orderBy("pos")))
    kept = keyed.where((F.col("seen") == 1) | (F.length("key") <= 30))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_kept"), F.md5(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "sentence"))), lambda x: x["sentence"]), " ")).alias("kept_md5"))


def _on_documents(operator):
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def queries() -> dict[str, tuple]:
    def q(operator, sql):
        return _on_documents(operator), sql

    sent = r"list_filter(list_transform(string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"
    sents = sent.format(t="text")
    w = "regexp_extract_all(lower(text), '[a-z0-9'']+')"
    syll = "list_sum(list_transform({w}, lambda x: greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN ends_with(x, 'e') AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)))"
    ease = "CASE WHEN len(w) = 0 OR len(s) = 0 THEN 0.0 ELSE 206.835 - 1.015 * (len(w)::DOUBLE / len(s)) - 84.6 * (" + syll.format(w="w") + "::DOUBLE / len(w)) END"
    gram = "CASE WHEN len(w) >= {n} THEN list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i+{m}], ' ')) ELSE [] END"
    entropy = f"""
      t AS (SELECT doc_id, {w} AS w FROM documents),
      g AS (SELECT doc_id, 1 AS size, unnest({gram.format(n=1, m=0)}) AS gram FROM t UNION ALL
            SELECT doc_id, 2, unnest({gram.format(n=2, m=1)}) FROM t UNION ALL SELECT doc_id, 3, unnest({gram.format(n=3, m=2)}) FROM t),
      c AS (SELECT doc_id, size, gram, count(*) AS n FROM g GROUP BY ALL),
      p AS (SELECT *, n::DOUBLE / sum(n) OVER (PARTITION BY doc_id, size) AS p FROM c),
      b AS (SELECT doc_id, size, -sum(p * log2(p)) AS h, count(*) AS v, max(p) AS top, sum(n - 1)::DOUBLE / sum(n) AS repeated, avg((n > 1)::INT) AS more FROM p GROUP BY ALL)"""
    return {
        "corpus_profile": q(corpus_profile, f"SELECT lang, count(*) AS n_docs, sum(n_chars)::BIGINT AS chars, sum(len({w}))::BIGINT AS words, count(DISTINCT source) AS sources, round(1 - count(DISTINCT sha256(text))::DOUBLE / count(*), 6) AS duplicate_ratio FROM documents GROUP BY lang"),
        "word_stats": q(word_stats, f"SELECT doc_id, len({w}) AS n_words, len(list_distinct({w})) AS n_distinct, len({sents}) AS n_sentences, round(len(list_distinct({w}))::DOUBLE / greatest(len({w}), 1), 6) AS type_token_ratio, greatest(1, length(text) // 4)::INT AS est_tokens FROM documents"),
        "flesch": q(readability, f"WITH t AS (SELECT doc_id, {w} AS w, {sents} AS s FROM documents) SELECT doc_id, round({ease}, 4) AS flesch FROM t"),
        "readability_oscillation": q(
            readability_oscillation,
            f"""WITH s AS (SELECT doc_id, unnest({sents}) AS x, unnest(range(len({sents}))) AS pos FROM documents),
            r AS (SELECT doc_id, pos // 5 AS run, string_agg(x, ' ' ORDER BY pos) AS text FROM s GROUP BY ALL),
            t AS (SELECT doc_id, {w} AS w, {sents} AS s FROM r)
            SELECT doc_id, count(*) AS n_runs, round(stddev_pop({ease}), 4) AS oscillation FROM t GROUP BY doc_id""",
        ),
        "ngram_entropy": q(
            ngram_entropy,
            f"""WITH {entropy},
            f AS (SELECT doc_id, coalesce(max(CASE WHEN size = 2 THEN CASE WHEN v > 1 THEN h / log2(v) ELSE 0 END END), 0) AS e2,
                         coalesce(max(CASE WHEN size = 3 THEN CASE WHEN v > 1 THEN h / log2(v) ELSE 0 END END), 0) AS e3,
                         coalesce(max(CASE WHEN size = 1 THEN top END), 0) AS top, coalesce(max(CASE WHEN size = 2 THEN repeated END), 0) AS rep FROM b GROUP BY doc_id),
            x AS (SELECT *, greatest(0, least(1, 0.6::DOUBLE * top + 0.4::DOUBLE * rep)) AS r FROM f)
            SELECT doc_id, round(e2, 6) AS bigram_entropy, round(e3, 6) AS trigram_entropy, round(r, 6) AS repetition,
                   round(greatest(0, least(1, 0.7::DOUBLE * greatest(0, least(1, 1 - (e2 + e3) / 2)) + 0.3::DOUBLE * r)), 6) AS score FROM x""",
        ),
        "repetition": q(
            repetition_signals,
            f"""WITH t AS (SELECT doc_id, {w} AS w, list_transform({sents}, lambda x: string_split(lower(x), ' ')[1]) AS s FROM documents),
            g AS (SELECT doc_id, s, {gram.format(n=5, m=4)} AS g FROM t)
            SELECT doc_id, round(CASE WHEN len(g) > 0 THEN (len(g) - len(list_distinct(g)))::DOUBLE / len(g) ELSE 0 END, 6) AS repeated_5grams,
                   round(CASE WHEN len(s) > 0 THEN (len(s) - len(list_distinct(s)))::DOUBLE / len(s) ELSE 0 END, 6) AS repeated_starts FROM g""",
        ),
        "chunk_quality": q(
            chunk_quality,
            r"""WITH a AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM documents),
            b AS (SELECT doc_id, length(t) AS n, regexp_replace(t, '\s+', '', 'g') AS c, list_filter(list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM a),
            d AS (SELECT doc_id, n, len(regexp_extract_all(c, '[A-Za-z]'))::DOUBLE / length(c) AS alpha, len(regexp_extract_all(c, '[^\w]'))::DOUBLE / length(c) AS symbol, 1 - len(list_distinct(l))::DOUBLE / len(l) AS rep FROM b),
            e AS (SELECT *, round(greatest(0, least(1, 0.4::DOUBLE * least(1.0, n / 150.0::DOUBLE) + 0.3::DOUBLE * alpha + 0.2::DOUBLE * (1 - symbol) + 0.1::DOUBLE * (1 - rep))), 3) AS quality FROM d)
            SELECT doc_id, round(alpha, 6) AS alpha_ratio, round(symbol, 6) AS symbol_ratio, round(rep, 6) AS repeat_ratio, quality,
                   CASE WHEN quality >= 0.8 THEN 'A' WHEN quality >= 0.6 THEN 'B' WHEN quality >= 0.4 THEN 'C' WHEN quality >= 0.2 THEN 'D' ELSE 'F' END AS grade,
                   n >= 40 AND quality >= 0.2 AND round(symbol, 6) <= 0.6 AS kept FROM e""",
        ),
        "text_quality": q(
            text_quality,
            f"""WITH t AS (SELECT doc_id, {w} AS w, len({sents}) AS s, len(regexp_extract_all(text, '[' || chr(65533) || ']'))::DOUBLE / greatest(length(text), 1) AS broken FROM documents),
            u AS (SELECT doc_id, broken, coalesce(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE, 0) / greatest(len(w), 1) AS wl, len(w)::DOUBLE / greatest(s, 1) AS sl FROM t),
            v AS (SELECT doc_id, round(20 * (0.4::DOUBLE * (1 - broken) + 0.3::DOUBLE * greatest(0, least(1, 1 - abs(wl - 5) / 5)) + 0.3::DOUBLE * greatest(0, least(1, 1 - abs(sl - 18) / 18))), 2) AS score FROM u)
            SELECT doc_id, score, CASE WHEN score * 5 >= 90 THEN 'A' WHEN score * 5 >= 75 THEN 'B' WHEN score * 5 >= 60 THEN 'C' WHEN score * 5 >= 40 THEN 'D' ELSE 'F' END AS grade FROM v""",
        ),
        "authorship": q(
            authorship,
            f"""WITH {entropy},
            a AS (SELECT doc_id, len({w}) AS n, len(regexp_extract_all(text, '[.,;:!?]'))::DOUBLE / greatest(len({w}), 1) AS punctuation,
                         list_transform({sents}, lambda y: len(regexp_extract_all(lower(y), '[a-z0-9'']+'))::DOUBLE) AS l FROM documents),
            e AS (SELECT a.doc_id, punctuation, len(l) AS k, CASE WHEN len(l) > 1 AND list_avg(l) <> 0 THEN list_stddev_samp(l) / list_avg(l) ELSE 0 END AS cv,
                         coalesce(CASE WHEN v > 1 THEN h / log2(v) ELSE 0 END, 0) AS entropy, coalesce(more, 0) AS repeated
                  FROM a LEFT JOIN b ON a.doc_id = b.doc_id AND b.size = 2)
            SELECT doc_id, round(entropy, 6) AS entropy, round(repeated, 6) AS repeated, round(cv, 6) AS length_cv, round(punctuation, 6) AS punctuation,
                   round(greatest(0, least(1, CASE WHEN entropy < 0.55 THEN (0.55::DOUBLE - entropy) * 0.8::DOUBLE ELSE 0 END + CASE WHEN repeated > 0.25 THEN least(0.4::DOUBLE, repeated) ELSE 0 END
                     + CASE WHEN cv < 0.35 AND k > 3 THEN 0.25::DOUBLE ELSE 0 END + CASE WHEN punctuation < 0.03 THEN 0.1::DOUBLE ELSE 0 END)), 6) AS score FROM e""",
        ),
        "hedging_and_voice": q(
            hedging_and_voice,
            f"""WITH t AS (SELECT doc_id, text, {w} AS w, len({sents}) AS s, len(regexp_extract_all(text, '(?i)\\b(?:be|is|was|were|been|being|am|are)\\s+[A-Za-z]+ed\\b')) AS p,
                len(regexp_extract_all(text, '\\b10\\.\\d{{4,9}}/[-._;()/:A-Za-z0-9]+\\b')) AS dois, regexp_extract_all(text, 'https?://[^\\s)>\\]]+') AS urls FROM documents)
            SELECT doc_id, round(greatest(0, least(1, len(list_filter(w, lambda x: list_contains({list(T.HEDGES)}, x)))::DOUBLE / greatest(len(w), 1) * 5)), 6) AS ambiguity,
                   p AS passive_count, round(greatest(0, least(1, p::DOUBLE / greatest(s, 1))), 6) AS passive_ratio, dois, len(urls) AS urls,
                   round(greatest(0, least(1, CASE WHEN contains(lower(text), 'doi') AND dois = 0 THEN 0.3::DOUBLE ELSE 0 END + least(0.7::DOUBLE, 0.1::DOUBLE * len(list_filter(urls, lambda u: contains(u, '..')))))), 6) AS citation_risk FROM t""",
        ),
        "text_hygiene": q(
            text_hygiene,
            r"""WITH t AS (SELECT doc_id, text, substr(text, 1, 500) AS h FROM documents)
            SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')) AS normal_md5,
                   md5(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g'), '[^\w\s]', '', 'g')) AS squeezed_md5,
                   length(text) >= 20 AND (len(regexp_extract_all(h, '[' || chr(65533) || ']'))::DOUBLE / length(h) > 0.1 OR (length(h) > 50 AND len(regexp_extract_all(h, '[A-Za-z0-9\s]'))::DOUBLE / length(h) < 0.3)) AS garbage,
                   length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 40 AND len(regexp_extract_all(text, '\S+')) >= 5 AND len(regexp_extract_all(text, '[A-Za-z0-9]'))::DOUBLE / greatest(length(text), 1) >= 0.2 AS valid,
                   CASE WHEN len(regexp_extract_all(text, '\p{L}')) = 0 THEN 'unknown' WHEN len(regexp_extract_all(text, '[A-Za-z]'))::DOUBLE / len(regexp_extract_all(text, '\p{L}')) >= 0.6 THEN 'en' ELSE 'non_en' END AS language FROM t""",
        ),
        "repeated_sentences_dropped": q(
            repeated_sentences_dropped,
            rf"""WITH s AS (SELECT doc_id, unnest({sents}) AS x, unnest(range(len({sents}))) AS pos FROM documents WHERE len({sents}) > 2),
            k AS (SELECT *, regexp_replace(regexp_replace(lower(x), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS key FROM s),
            r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, key ORDER BY pos) AS seen FROM k)
            SELECT doc_id, count(*) AS n_kept, md5(string_agg(x, ' ' ORDER BY pos)) AS kept_md5 FROM r WHERE seen = 1 OR length(key) <= 30 GROUP BY doc_id""",
        ),
    }


