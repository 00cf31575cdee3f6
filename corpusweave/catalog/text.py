"""Queries over the scalar text and array functions."""

from pyspark.sql import functions as F

from ..functions import arrays, code, outcomes, text
from ..functions.hashing import adler32, content_id, uniform
from .base import DOCS, PAIRS, STATUS, docs, pairs, query, sql_adler32, sql_uniform, sql_words, table

_MARKED = "'VAR_' || doc_id || ' FUNC_' || lang || ' CLASS_' || source || ' ' || text"


def _marked():
    return F.concat(F.lit("VAR_"), "doc_id", F.lit(" FUNC_"), "lang", F.lit(" CLASS_"), "source", F.lit(" "), "text")


@query("protect_names", f"""
SELECT doc_id, replace(replace(replace({_MARKED}, 'VAR_', 'var_'), 'FUNC_', 'func_'), 'CLASS_', 'class_') AS content
FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.protect_names(_marked()).alias("content"))


_PUNCT = r"""
step1 AS (SELECT {key}, regexp_replace(replace(replace(replace({col}, ' ', ' ▁ '), chr(10), ' STRNEWLINE '), chr(9), ' TABSYMBOL '), ' +', ' ', 'g') AS t FROM {src}),
step2 AS (SELECT {key}, regexp_replace(regexp_replace(regexp_replace(t, '(\P{{N}})(\p{{P}})', '\1 \2 ', 'g'),
  '(\p{{P}})(\P{{N}})', ' \1 \2', 'g'), '(\p{{S}})', ' \1 ', 'g') AS t FROM step1),
step3 AS (SELECT {key}, trim(regexp_replace(t, '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ' ', 'g')) AS t FROM step2),
tokenized AS (SELECT {key}, CASE WHEN regexp_matches(substr(t, 1, 1), '^\p{{L}}$')
  THEN replace(t, substr(t, 1, 1) || ' ', substr(t, 1, 1)) ELSE t END AS t FROM step3)"""


@query("tokenize_string", "WITH " + _PUNCT.format(key="doc_id", col="text", src="documents") + """
SELECT doc_id, t AS tokens FROM tokenized""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.tokenize_string("text").alias("tokens"))


@query("detokenize_string", "WITH " + _PUNCT.format(key="doc_id", col="text", src="documents") + """
SELECT doc_id, replace(replace(t, ' ', ''), '▁', ' ') AS content FROM tokenized""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.detokenize_string(text.tokenize_string("text")).alias("content"))


@query("normalize_comment", r"""
WITH c AS (SELECT doc_id, string_split(regexp_replace(text, ' +', ' ', 'g'), '') AS l FROM documents),
r AS (SELECT doc_id, array_to_string([l[i] FOR i IN range(1, len(l) + 1) IF NOT (i > 5 AND l[i] <> chr(10)
  AND l[i] = l[i-1] AND l[i] = l[i-2] AND l[i] = l[i-3] AND l[i] = l[i-4] AND l[i] = l[i-5])], '') AS t FROM c)
SELECT doc_id, CASE WHEN length(regexp_replace(t, '[^\pL\pN_]', '', 'g')) < 2 THEN '' ELSE t END AS comment FROM r""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.normalize_comment("text").alias("comment"))


@query("strip_accents", "SELECT doc_id, strip_accents(lower(text)) AS content FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.strip_accents("text").alias("content"))


_SPLIT_WORDS = r"regexp_replace(text, '(\w\w)(\w)', '\1@@ \2', 'g')"


@query("restore_bpe", rf"""
SELECT doc_id, regexp_replace({_SPLIT_WORDS}, '(@@ )|(@@ ?$)', '', 'g') AS content FROM documents""")
def _(spark, sf):
    split = F.regexp_replace("text", r"(\w\w)(\w)", "$1@@ $2")
    return docs(spark, sf).select("doc_id", text.restore_bpe(split).alias("content"))


def _sql_repair(column):
    out = column
    for prefix in ("VAR_", "FUNC_", "CLASS_"):
        broken = "(?:@@ )?".join(prefix)
        out = f"regexp_replace({out}, '{broken}(?:@@ )?([0-9]+(?:$| ))', '{prefix}\\1', 'g')"
        for _ in range(3):
            out = f"regexp_replace({out}, '({prefix}[0-9]+)@@ ([0-9]+)', '\\1\\2', 'g')"
    return out


@query("repair_identifiers", f"""
SELECT doc_id, {_sql_repair("'V@@ AR@@ _@@ ' || doc_id || ' FUNC_1@@ ' || n_chars || '@@ 7 CL@@ ASS_@@ 3 ' || text")} AS content
FROM documents""")
def _(spark, sf):
    broken = F.concat(
        F.lit("V@@ AR@@ _@@ "), "doc_id", F.lit(" FUNC_1@@ "), "n_chars", F.lit("@@ 7 CL@@ ASS_@@ 3 "), "text"
    )
    return docs(spark, sf).select("doc_id", text.repair_identifiers(broken).alias("content"))


@query("repair_spaced_identifiers", """
SELECT doc_id, 'x Ġ CLASS_' || doc_id || ' Ġ VAR_' || doc_id || n_chars || ' y FUNC_7 ' || text AS content FROM documents""")
def _(spark, sf):
    broken = F.concat(F.lit("x ĠCLASS _ "), "doc_id", F.lit(" ĠV AR _ "), "doc_id", F.lit(" "), "n_chars", F.lit(" y FUN C _ 7 "), "text")
    return docs(spark, sf).select("doc_id", text.repair_spaced_identifiers(broken).alias("content"))


@query("content_id", """
SELECT doc_id, sha256(text) AS content_id, 'CLASS_' || sha256(text) AS class_name,
       sha256(text) AS id_back FROM documents""")
def _(spark, sf):
    named = docs(spark, sf).withColumn("class_name", text.class_name("text"))
    return named.select(
        "doc_id", content_id("text").alias("content_id"), "class_name", text.id_from_class_name("class_name").alias("id_back")
    )


@query("clip_text", "SELECT doc_id, substr(text, 1, 150) AS clipped FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", text.clip("text").alias("clipped"))


@query("escape_unk", """
SELECT doc_id, replace(replace(text, 'the', '<unk>'), '<unk>', '<<unk>>') AS content FROM documents""")
def _(spark, sf):
    marked = F.replace(F.col("text"), F.lit("the"), F.lit("<unk>"))
    return docs(spark, sf).select("doc_id", text.escape_unk(marked).alias("content"))


@query("dictionary_round_trip", """
SELECT doc_id, 'CLASS_0 ' || lang || ' | FUNC_0 ' || source || ' | VAR_0 n' || n_chars AS dictionary,
       source AS func_name FROM documents""")
def _(spark, sf):
    raw = F.concat(F.lit("VAR_0 n"), "n_chars", F.lit(" | CLASS_0 "), "lang", F.lit(" | FUNC_0 "), "source")
    parsed = docs(spark, sf).withColumn("d", text.parse_dictionary(raw))
    return parsed.select("doc_id", text.format_dictionary("d").alias("dictionary"), F.col("d")["FUNC_0"].alias("func_name"))


_SNAKE = r"""lower(substr(p, 1, 1)) || translate(regexp_replace(substr(p, 2), '([A-Z])', '_\1', 'g'),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"""


@query("subtokens", rf"""
WITH w AS (SELECT doc_id, w AS word FROM documents, unnest({sql_words('text')}) AS u(w)),
d AS (SELECT DISTINCT doc_id, word, regexp_replace(word, '[\-.\s]', '_', 'g') AS p FROM w)
SELECT doc_id, word, array_to_string(list_sort(list_distinct([x FOR x IN string_split({_SNAKE}, '_') IF x <> ''])), ' ') AS parts
FROM d""")
def _(spark, sf):
    word = docs(spark, sf).select("doc_id", F.explode(text.words("text")).alias("word")).distinct()
    return word.select("doc_id", "word", F.array_join(F.array_sort(text.subtokens("word")), " ").alias("parts"))


@query("split_id_line", r"""
WITH l AS (SELECT doc_id, string_split(source || ' | ' || lang || ' | ' || text, ' | ') AS p FROM documents)
SELECT doc_id, array_to_string(p[2:], ' | ') AS rest, p[1] AS id, p[2] AS code FROM l""")
def _(spark, sf):
    line = F.concat_ws(" | ", "source", "lang", "text")
    pair = text.split_id_line(line, "pair")
    return docs(spark, sf).select(
        "doc_id",
        text.split_id_line(line, "rest").alias("rest"),
        pair["id"].alias("id"),
        text.split_id_line(line, "code").alias("code"),
    )


@query("adler32_and_draws", f"""
SELECT doc_id, {sql_adler32("lang || '/' || source || ' '")} AS checksum, {sql_uniform(42, 'doc_id')} AS draw
FROM documents""")
def _(spark, sf):
    return docs(spark, sf).select(
        "doc_id", adler32(F.concat("repo", F.lit(" "))).alias("checksum"), uniform(42, "doc_id").alias("draw")
    )


# Functions as token strings, derived from the documents.
_FUNC_SQL = """'public static ' || CASE lang WHEN 'en' THEN 'int' WHEN 'fr' THEN 'void' ELSE 'Map' END
 || ' fn_' || doc_id || ' ( final int [ ] ' || lang || ' , String ' || source || ' ) { return g ( ' || n_chars || ' ) ; }'"""


def _function():
    kind = F.when(F.col("lang") == "en", "int").when(F.col("lang") == "fr", "void").otherwise("Map")
    return F.concat(
        F.lit("public static "), kind, F.lit(" fn_"), "doc_id", F.lit(" ( final int [ ] "), "lang",
        F.lit(" , String "), "source", F.lit(" ) { return g ( "), "n_chars", F.lit(" ) ; }"),
    )


@query("function_signature", """
SELECT doc_id, 'fn_' || doc_id AS name, 'final int [ ]|String ' AS types, lang || '|' || source AS names,
       CASE lang WHEN 'en' THEN 'int' WHEN 'fr' THEN 'void' ELSE 'Map' END AS return_type FROM documents""")
def _(spark, sf):
    f = docs(spark, sf).withColumn("tokens", F.split(_function(), " "))
    args = code.arguments("tokens")
    return f.select(
        "doc_id",
        code.function_name("tokens").alias("name"),
        F.array_join(F.transform(args, lambda a: a["type"]), "|").alias("types"),
        F.array_join(F.transform(args, lambda a: a["name"]), "|").alias("names"),
        code.return_type("tokens").alias("return_type"),
    )


@query("supported_signature", "SELECT doc_id, lang IN ('en', 'fr') AS supported FROM documents")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", code.supported_signature(F.split(_function(), " ")).alias("supported"))


@query("uses_io", """
SELECT doc_id, contains(replace(text || ' java . io . ' || CASE lang WHEN 'de' THEN 'File ( x' WHEN 'es' THEN 'FileWriter' ELSE 'Path' END, ' ', ''), 'java.io.File(')
   OR contains(replace(text || ' java . io . ' || CASE lang WHEN 'de' THEN 'File ( x' WHEN 'es' THEN 'FileWriter' ELSE 'Path' END, ' ', ''), 'io.FileWriter')
   OR contains(replace(text, ' ', ''), 'zip.ZipFile') OR contains(text, 'IOException') AS uses_io
FROM documents""")
def _(spark, sf):
    tail = F.when(F.col("lang") == "de", "File ( x").when(F.col("lang") == "es", "FileWriter").otherwise("Path")
    return docs(spark, sf).select(
        "doc_id", code.uses_io(F.concat("text", F.lit(" java . io . "), tail)).alias("uses_io")
    )


@query("is_python3", r"""
WITH f AS (SELECT doc_id, text || CASE lang WHEN 'de' THEN ' print x' WHEN 'es' THEN ' raise Oops , 1' WHEN 'fr' THEN ' xrange ( 3 )' ELSE ' print ( x )' END AS c FROM documents)
SELECT doc_id, NOT (regexp_matches(c, 'print [^(]') OR regexp_matches(c, 'raise [\pL\pN_]+ ,') OR regexp_matches(c, 'except [\pL\pN_]+ ,')
  OR regexp_matches(c, '[^ ]+ = \d+ L') OR contains(c, '. iterkeys ( )') OR contains(c, '. itervalues ( )')
  OR contains(c, '. iteritems ( )') OR contains(c, 'xrange (') OR contains(c, 'imap (')) AS python3 FROM f""")
def _(spark, sf):
    tail = (
        F.when(F.col("lang") == "de", " print x").when(F.col("lang") == "es", " raise Oops , 1")
        .when(F.col("lang") == "fr", " xrange ( 3 )").otherwise(" print ( x )")
    )
    return docs(spark, sf).select("doc_id", code.is_python3(F.concat("text", tail)).alias("python3"))


_TEST_SQL = """CASE event_type WHEN 'error' THEN 'try assert ' WHEN 'view' THEN 'assert a assert b' WHEN 'signup' THEN 'pass' ELSE 'assert ' || props END"""


def _test_text():
    kind = F.col("event_type")
    return (
        F.when(kind == "error", F.lit("try assert ")).when(kind == "view", F.lit("assert a assert b"))
        .when(kind == "signup", F.lit("pass")).otherwise(F.concat(F.lit("assert "), "props"))
    )


@query("usable_test", f"""
SELECT event_id, NOT contains(t, 'try ') AND NOT contains(t, 'catch(') AND contains(t, 'assert ') AS usable,
       ((length(t) - length(replace(t, 'assert ', ''))) // 7)::INT AS asserts
FROM (SELECT event_id, {_TEST_SQL} AS t FROM events)""")
def _(spark, sf):
    tests = table(spark, sf, "events").withColumn("t", _test_text())
    return tests.select("event_id", code.usable_test("t").alias("usable"), code.assert_count("t").alias("asserts"))


@query("parse_test_output", f"""
SELECT event_id, 'python' AS flavour, CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'error' END AS status,
  CASE WHEN event_type IN ('purchase', 'error') THEN user_id::INT END AS n_tests,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 2 END::INT AS n_failures FROM events
UNION ALL
SELECT event_id, 'cpp', CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'error' END,
  CASE WHEN event_type IN ('purchase', 'error') THEN user_id::INT END,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 2 END::INT FROM events
UNION ALL
SELECT event_id, 'script', CASE event_type WHEN 'purchase' THEN 'success' WHEN 'error' THEN 'failure' ELSE 'error' END,
  CASE WHEN event_type IN ('purchase', 'error') THEN user_id::INT + 2 END,
  CASE event_type WHEN 'purchase' THEN 0 WHEN 'error' THEN 2 END::INT FROM events""")
def _(spark, sf):
    kind, n = F.col("event_type"), F.col("user_id").cast("string")
    broken = F.concat(F.lit("Traceback\n"), "props")
    python = (
        F.when(kind == "purchase", F.concat(F.lit("..\nRan "), n, F.lit(" tests in 0.1s\n\nOK\n")))
        .when(kind == "error", F.concat(F.lit("F.\nRan "), n, F.lit(" tests in 0.1s\n\nFAILED (errors=2)\n")))
        .otherwise(broken)
    )
    cpp_head = F.concat(F.lit("[==========] Running 9 tests.\n[==========] "), n, F.lit(" tests from 1 suite ran.\n"))
    cpp = (
        F.when(kind == "purchase", F.concat(cpp_head, F.lit("[  PASSED  ] all\n")))
        .when(kind == "error", F.concat(cpp_head, F.lit(" 2 FAILED TESTS\n")))
        .otherwise(broken)
    )
    total = (F.col("user_id") + 2).cast("string")
    script = (
        F.when(kind == "purchase", F.concat(F.lit("x\n#Results:"), total, F.lit(", "), total))
        .when(kind == "error", F.concat(F.lit("x\n#Results:"), n, F.lit(", "), total))
        .otherwise(broken)
    )
    runs = table(spark, sf, "events").select(
        "event_id",
        F.explode(F.array(*[
            F.struct(F.lit(flavour).alias("flavour"), outcomes.parse_outcome(raw, flavour).alias("o"))
            for flavour, raw in (("python", python), ("cpp", cpp), ("script", script))
        ])).alias("r"),
    )
    return runs.select("event_id", "r.flavour", "r.o.*")


@query("parse_result_tuple", f"""
SELECT event_id, {STATUS} AS status, user_id::INT AS n_tests, props AS detail FROM events""")
def _(spark, sf):
    kind = F.col("event_type")
    status = (
        F.when(kind == "purchase", "success").when(kind == "error", "failure").when(kind == "view", "timeout").otherwise("compile_error")
    )
    raw = F.concat(F.lit("('"), status, F.lit("', "), "user_id", F.lit(", '"), "props", F.lit("')"))
    parsed = outcomes.parse_result_tuple(raw)
    return table(spark, sf, "events").select("event_id", parsed["status"].alias("status"), parsed["n_tests"].alias("n_tests"), parsed["detail"].alias("detail"))


# Id arrays: word lengths of the document plus the ordinary-id offset stand for token ids.
_IDS_SQL = f"[(length(w) + 514)::INT FOR w IN {sql_words('text')}]"


def _ids(column="text"):
    return F.transform(text.words(column), lambda w: F.length(w) + 514)


@query("pad_ids", f"""
WITH i AS (SELECT doc_id, {_IDS_SQL} AS ids FROM documents),
w AS (SELECT doc_id, [1] || ids || [1] AS ids FROM i),
c AS (SELECT doc_id, CASE WHEN len(ids) > 128 THEN ids[1:127] || [1] ELSE ids END AS ids FROM w)
SELECT doc_id, array_to_string(ids || [2 FOR x IN range(128 - len(ids))], ' ') AS ids FROM c""")
def _(spark, sf):
    return docs(spark, sf).select("doc_id", F.array_join(arrays.pad_ids(_ids(), 128), " ").alias("ids"))


_CONCAT_SQL = f"""
WITH {PAIRS}, i AS (SELECT pair_id, [1] || [(length(w) + 514)::INT FOR w IN {sql_words('source')}] || [1] AS a,
  [1] || [(length(w) + 514)::INT FOR w IN {sql_words('target')}] || [1] AS b FROM pairs)
SELECT pair_id, array_to_string(a || b, ' ') AS ids,
  array_to_string(range(len(a)) || range(len(b)), ' ') AS positions,
  array_to_string([0 FOR x IN a] || [1 FOR x IN b], ' ') AS langs,
  array_to_string(a[1:len(a) - 1] || b, ' ') AS joined_ids FROM i"""


@query("concat_pair", _CONCAT_SQL)
def _(spark, sf):
    a, b = arrays.wrap_ids(_ids("source")), arrays.wrap_ids(_ids("target"))
    both, shared = arrays.concat_pair(a, b, 0, 1), arrays.concat_pair(a, b, 0, 1, reset_positions=False)
    return pairs(spark, sf).select(
        "pair_id",
        F.array_join(both["ids"], " ").alias("ids"),
        F.array_join(both["positions"], " ").alias("positions"),
        F.array_join(both["langs"], " ").alias("langs"),
        F.array_join(shared["ids"], " ").alias("joined_ids"),
    )


@query("split_sentence_id", f"""
WITH i AS (SELECT doc_id, {_IDS_SQL} AS ids FROM documents)
SELECT doc_id, doc_id || ' ' || n_chars AS head, array_to_string(ids, ' ') AS tail
FROM i JOIN documents USING (doc_id)""")
def _(spark, sf):
    joined = F.concat(F.array(F.col("doc_id").cast("int") + 1000, F.col("n_chars").cast("int") + 1000), F.array(F.lit(4)), _ids())
    parts = arrays.split_sentence_id(joined, 4)
    return docs(spark, sf).select(
        "doc_id",
        F.array_join(F.transform(parts["head"], lambda x: x - 1000), " ").alias("head"),
        F.array_join(parts["tail"], " ").alias("tail"),
    )
