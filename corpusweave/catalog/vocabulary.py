"""Queries over token counts, vocabularies, indexing and sub-words."""

from pyspark.sql import functions as F

from ..functions.arrays import wrap_ids
from ..functions.text import restore_bpe, words
from ..operators import bpe, dedup, filters, splits, vocab
from .base import TOKENS, VOCAB, doc_tokens, docs, pairs, PAIRS, query, sql_adler32, sql_words

_BUCKET = sql_adler32("source || ' '")


@query("train_token_counts", f"""
WITH d AS (SELECT *, row_number() OVER (PARTITION BY lang, sha256(text) ORDER BY doc_id) AS rn FROM documents),
t AS (SELECT unnest({sql_words('text')}) AS token FROM d WHERE rn = 1 AND {_BUCKET} % 100 >= 20)
SELECT token, count(*) AS count FROM t GROUP BY token ORDER BY count DESC, token LIMIT 100""")
def _(spark, sf):
    """Content dedup → repository split → token counts of the train part → top 100."""
    d = docs(spark, sf)
    kept = dedup.dedup_content(d, "text", "doc_id", ["lang"])
    train = splits.split_by_hash(kept, F.concat("repo", F.lit(" ")), 10, 10).filter("split = 'train'")
    return vocab.count_tokens(train, words("text"), 100)


@query("count_tokens", f"WITH {TOKENS}, {VOCAB} SELECT token, count FROM vocab")
def _(spark, sf):
    return vocab.count_tokens(doc_tokens(spark, sf), "tokens")


@query("build_vocab", f"WITH {TOKENS}, {VOCAB} SELECT token, id, count FROM vocab")
def _(spark, sf):
    built = vocab.build_vocab(vocab.count_tokens(doc_tokens(spark, sf), "tokens"))
    return built.filter(F.col("id") >= vocab.FIRST_ORDINARY)


@query("reserved_vocab_check")
def _(spark, sf):
    built = vocab.build_vocab(vocab.count_tokens(doc_tokens(spark, sf), "tokens"))
    bad = filters.check_vocab(built, vocab.FIRST_ORDINARY)
    return built.agg(F.count(F.lit(1)).alias("size")).withColumn("violations", F.lit(bad.count()))


@query("truncate_vocab", f"WITH {TOKENS}, {VOCAB} SELECT token, id, count FROM vocab WHERE id < 20000 AND count >= 5")
def _(spark, sf):
    built = vocab.build_vocab(vocab.count_tokens(doc_tokens(spark, sf), "tokens"))
    return vocab.truncate_vocab(built, 20000, 5).filter(F.col("id") >= vocab.FIRST_ORDINARY)


_INDEXED = f"""{TOKENS}, {VOCAB}, small AS (SELECT token, id FROM vocab WHERE id < 5000),
looked AS (SELECT doc_id, i, coalesce(id, 3) AS id FROM (SELECT doc_id, unnest(range(len(tokens))) AS i, unnest(tokens) AS token FROM doc_tokens) LEFT JOIN small USING (token)),
indexed AS (SELECT d.doc_id, coalesce(list(l.id ORDER BY l.i) FILTER (WHERE l.id IS NOT NULL), []) || [1] AS ids FROM documents d LEFT JOIN looked l USING (doc_id) GROUP BY d.doc_id)"""


def _small_vocab(spark, sf):
    return vocab.truncate_vocab(vocab.build_vocab(vocab.count_tokens(doc_tokens(spark, sf), "tokens")), 5000, 0)


@query("index_corpus", f"WITH {_INDEXED} SELECT doc_id, array_to_string(ids, ' ') AS ids FROM indexed")
def _(spark, sf):
    indexed = vocab.index_corpus(doc_tokens(spark, sf), "doc_id", "tokens", _small_vocab(spark, sf))
    return indexed.select("doc_id", F.array_join("ids", " ").alias("ids"))


@query("ids_to_text", f"""
WITH {_INDEXED} SELECT doc_id, coalesce((SELECT string_agg(coalesce(s.token, '<unk>'), ' ' ORDER BY l.i) FROM looked l LEFT JOIN small s USING (id) WHERE l.doc_id = d.doc_id), '') AS text FROM documents d""")
def _(spark, sf):
    small = _small_vocab(spark, sf)
    indexed = vocab.index_corpus(doc_tokens(spark, sf), "doc_id", "tokens", small)
    body = indexed.withColumn("ids", wrap_ids(F.slice("ids", F.lit(1), F.size("ids") - 1)))
    return vocab.ids_to_text(body, "doc_id", "ids", small)


@query("unk_report", f"""
WITH {TOKENS}, {VOCAB}, small AS (SELECT token FROM vocab WHERE id < 600)
SELECT token, count, round(count / (SELECT sum(count) FROM counts), 9) AS share FROM counts WHERE token NOT IN (SELECT token FROM small)
  AND (SELECT count(*) FROM counts WHERE token NOT IN (SELECT token FROM small)) < 10000000 ORDER BY count DESC, token LIMIT 30""")
def _(spark, sf):
    known = vocab.truncate_vocab(vocab.build_vocab(vocab.count_tokens(doc_tokens(spark, sf), "tokens")), 600, 0)
    report = vocab.unk_report(doc_tokens(spark, sf), "tokens", known)
    return report.withColumn("share", F.round("share", 9))


@query("corpus_stats", f"""
WITH {_INDEXED} SELECT (SELECT count(*) FROM looked) AS words, 5000 AS unique_words, (SELECT count(*) FROM documents) AS sentences,
  (SELECT count(*) FROM looked WHERE id = 3) AS unknown, round(100.0::DOUBLE * (SELECT count(*) FROM looked WHERE id = 3) / (SELECT count(*) FROM looked), 9) AS unk_percent""")
def _(spark, sf):
    small = _small_vocab(spark, sf)
    indexed = vocab.index_corpus(doc_tokens(spark, sf), "doc_id", "tokens", small)
    return vocab.corpus_stats(indexed, small).withColumn("unk_percent", F.round("unk_percent", 9))


@query("mask_weights", f"WITH {TOKENS}, {VOCAB} SELECT token, id, round(pow(greatest(count, 1)::DOUBLE, -0.5), 9) AS weight FROM vocab")
def _(spark, sf):
    built = vocab.build_vocab(vocab.count_tokens(doc_tokens(spark, sf), "tokens"))
    weighted = vocab.mask_weights(built, 0.5).filter(F.col("id") >= vocab.FIRST_ORDINARY)
    return weighted.select("token", "id", F.round("weight", 9).alias("weight"))


def _codes(spark, sf, n):
    counts = vocab.count_tokens(doc_tokens(spark, sf), "tokens", None).withColumnRenamed("token", "word")
    return bpe.learn_bpe(counts, n)


def _bpe_sql(merges: int) -> str:
    """`state`: after each merge, every word with two blanks between its symbols and one around."""
    return f"""words AS (SELECT token AS word, count(*) AS c FROM (SELECT unnest({sql_words('text')}) AS token FROM documents) GROUP BY token),
state AS (
  SELECT 0 AS step, NULL::VARCHAR AS l, NULL::VARCHAR AS r, NULL::BIGINT AS n, word, ' ' || array_to_string(string_split(word, ''), '  ') || '</w> ' AS s, c FROM words
  UNION ALL
  SELECT step + 1, t.l, t.r, t.n, word, replace(s, ' ' || t.l || '  ' || t.r || ' ', ' ' || t.l || t.r || ' '), c
  FROM state, (
    SELECT p.l AS l, p.r AS r, sum(c)::BIGINT AS n
    FROM (SELECT unnest(list_transform(list_zip(x[:-2], x[2:]), lambda z: struct_pack(l := z[1], r := z[2]))) AS p, c
          FROM (SELECT string_split(trim(s, ' '), '  ') AS x, c FROM state)) GROUP BY ALL
    ORDER BY n DESC, l, r LIMIT 1) t
  WHERE step < {merges})"""


@query("learn_bpe", f"""WITH RECURSIVE {_bpe_sql(200)}
SELECT DISTINCT (step - 1)::INT AS rank, l AS "left", r AS "right", n AS count FROM state WHERE step > 0""")
def _(spark, sf):
    return _codes(spark, sf, 200)


@query("apply_bpe", f"""WITH RECURSIVE {_bpe_sql(30)},
pieces AS (SELECT word, replace(regexp_replace(trim(s, ' '), '</w>$', ''), '  ', '@@ ') AS piece FROM state WHERE step = 30),
placed AS (SELECT doc_id, unnest(tokens) AS word, generate_subscripts(tokens, 1) AS i FROM (SELECT doc_id, {sql_words('text')} AS tokens FROM documents))
SELECT d.doc_id, coalesce(t.text, '') AS text FROM documents d
LEFT JOIN (SELECT doc_id, string_agg(piece, ' ' ORDER BY i) AS text FROM placed JOIN pieces USING (word) GROUP BY doc_id) t USING (doc_id)""")
def _(spark, sf):
    return bpe.apply_bpe(doc_tokens(spark, sf), "doc_id", "tokens", _codes(spark, sf, 30))


@query("bpe_round_trip", f"SELECT doc_id, array_to_string({sql_words('text')}, ' ') AS text FROM documents")
def _(spark, sf):
    applied = bpe.apply_bpe(doc_tokens(spark, sf), "doc_id", "tokens", _codes(spark, sf, 30))
    return applied.select("doc_id", restore_bpe("text").alias("text"))


@query("pair_vocab", f"""
WITH {PAIRS}, t AS (SELECT unnest({sql_words('source')}) AS token FROM pairs UNION ALL SELECT unnest({sql_words('target')}) FROM pairs)
SELECT token, count(*) AS count FROM t GROUP BY token""")
def _(spark, sf):
    both = pairs(spark, sf).select(F.explode(F.array("source", "target")).alias("line"))
    return vocab.count_tokens(both, words("line"), None)
