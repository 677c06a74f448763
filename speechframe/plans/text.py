"""Text cleaning and routing over documents and conversations (T, P14, L3, W24, W25)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import rules
from ..registry import query
from ..session import table

RULES = [("the", "LE"), ("thand", "le et"), ("of", r"d\1$1"), ("ing.", "ing!")]


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", "text")


def spiced(spark, d, phrases: list[str]):
    """The whole texts with a phrase put in after character 80, so that the rules have something to find."""
    pick = F.element_at(F.array(*map(F.lit, phrases)), (F.pmod("doc_id", F.lit(len(phrases))) + 1).cast("int"))
    return docs(spark, d).select("doc_id", F.concat(F.left("text", F.lit(80)), F.lit(" "), pick, F.lit(" "), F.substring("text", 81, 1 << 30)).alias("text"))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def spiced_sql(phrases: list[str]) -> str:
    return f"s AS (SELECT doc_id, left(text, 80) || ' ' || list_extract([{', '.join(map(quoted, phrases))}], CAST(doc_id % {len(phrases)} + 1 AS INT)) || ' ' || substr(text, 81) AS text FROM documents)"


def replaced_sql(column: str, patterns: list[str]) -> str:
    """Replacements by a space, in order and in any case."""
    for p in patterns:
        column = f"regexp_replace({column}, {quoted('(?i)' + p)}, ' ', 'g')"
    return column


@query("t1_glossary", """SELECT doc_id, sha256(text) AS sha FROM (SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-zÀ-ɏ0-9_]+|[^A-Za-zÀ-ɏ0-9_]+'), lambda w: CASE lower(w) WHEN 'the' THEN 'LE' WHEN 'thand' THEN 'le et' WHEN 'of' THEN 'd\\1$1' ELSE w END), '') AS text FROM documents)""")
def t1(spark, d):
    given = spark.createDataFrame([(i, *r) for i, r in enumerate(RULES[:3])], "ord int, wrong string, right string")
    return rules.glossary(docs(spark, d).select("doc_id", "text"), "text", given).select("doc_id", F.sha2("text", 256).alias("sha"))


TOKENS_SQL = "regexp_extract_all({0}, '[A-Za-zÀ-ɏ0-9_]+|[^A-Za-zÀ-ɏ0-9_]+')"


def benchmark_words(spark, d):
    """(word, least item) of the words of the benchmark, in a-z."""
    w = table(spark, d, "benchmark").select("item_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("(?U)([a-z]+)(?![\\w])"), F.lit(1))).alias("word"))
    return w.where("length(word) > 3").groupBy("word").agg(F.min("item_id").alias("item"))


WORDS_SQL = "r AS (SELECT word, min(item_id) AS item FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '([a-z]+)(?:[^A-Za-zÀ-ɏ0-9_]|$)', 1)) AS word FROM benchmark) WHERE length(word) > 3 GROUP BY 1)"


@query("t1_nfc_documents", "SELECT doc_id, sha256(nfc_normalize(text)) AS sha FROM documents")
def nfc(spark, d):
    """The NFC invariant: a glossary without rules."""
    none = spark.createDataFrame([], "ord int, wrong string, right string")
    return rules.glossary(docs(spark, d).select("doc_id", "text"), "text", none).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("t1_rule_table", f"""WITH {WORDS_SQL}, t AS (SELECT doc_id, {TOKENS_SQL.format('text')} AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
    g AS (SELECT doc_id, string_agg(CASE WHEN word IS NULL THEN x ELSE upper(word) END, '' ORDER BY i) AS text FROM u LEFT JOIN r ON word = lower(x) GROUP BY 1)
    SELECT d.doc_id, sha256(coalesce(g.text, '')) AS sha FROM documents d LEFT JOIN g USING (doc_id)""")  # fmt: skip
def t1_table(spark, d):
    """Every word of the benchmark is a rule: thousands of them, one automaton."""
    given = benchmark_words(spark, d).select(F.col("word").alias("ord"), F.col("word").alias("wrong"), F.upper("word").alias("right"))
    return rules.glossary(docs(spark, d).select("doc_id", "text"), "text", given).select("doc_id", F.sha2("text", 256).alias("sha"))


@query("t25_rule_table", f"""WITH {WORDS_SQL}, n AS (SELECT doc_id, translate(lower(text), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS t FROM documents),
    x AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[A-Za-zÀ-ɏ0-9_]+')) AS word FROM n), c AS (SELECT doc_id, item % 7 AS o, count(*) AS s FROM x JOIN r USING (word) GROUP BY ALL),
    b AS (SELECT doc_id, arg_min(o, (-s, o)) AS o FROM c GROUP BY 1) SELECT d.doc_id, CASE WHEN o IS NULL THEN 'inbox' ELSE 'bucket ' || o END AS bucket FROM documents d LEFT JOIN b USING (doc_id)""")  # fmt: skip
def t25_table(spark, d):
    """J13 and T25 with keywords from a table."""
    given = benchmark_words(spark, d).select((F.col("item") % 7).alias("ord"), F.concat(F.lit("bucket "), F.col("item") % 7).alias("bucket"), F.col("word").alias("keyword"))
    return rules.routed(docs(spark, d).select("doc_id", "text"), "text", given, "inbox").select("doc_id", "bucket")


SNIPPETS = [("brb", "be right back"), ("brb soon", "back in a minute"), ("sig", "Best regards")]


@query("t2_snippets", f"""WITH {spiced_sql(['brb soon', 'BRB', 'sig', 'nothing'])} SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, 'brb soon', 'back in a minute') WHEN 1 THEN replace(text, 'BRB', 'be right back') WHEN 2 THEN replace(text, ' sig ', ' Best regards ') ELSE text END AS text FROM s""")
def t2(spark, d):
    """Longest trigger first."""
    ordered = sorted(SNIPPETS, key=lambda s: (-len(s[0]), s[0]))
    return spiced(spark, d, ["brb soon", "BRB", "sig", "nothing"]).select("doc_id", text.glossary(F.col("text"), ordered).alias("text"))


FILLED = ["euhhh", "Genre, ", "du coup", "bonjour"]


#: Written out for DuckDB, apart from the library's words.
FILLERS_SQL = "euh+|heu+|hum+|hein|ben|bah|beh|tu vois|vous voyez|du coup|en fait|genre"
LEADS_SQL = "alors|voil[àa]|enfin|bon|donc|et donc|ben"


def fillers_sql(column: str) -> str:
    """RE2 knows only ASCII word edges, so every word is put between two signs of its own, which go at the end."""
    among = lambda x: x.replace(" ", r"\x02 \x01")
    marked = f"regexp_replace({column}, '([A-Za-zÀ-ɏ0-9_]+)', chr(1) || '\\1' || chr(2), 'g')"
    plain = f"regexp_replace({marked}, {quoted(rf'(?i)\x01(?:{among(FILLERS_SQL)})\x02[\s,]*')}, ' ', 'g')"
    led = f"regexp_replace({plain}, {quoted(rf'(?i)(^|[.!?]\s+)\x01(?:{among(LEADS_SQL)})\x02[\s,]*')}, '\\1', 'g')"
    return f"regexp_replace({led}, '[\\x01\\x02]', '', 'g')"


@query("t3_fillers", f"WITH {spiced_sql(FILLED)} SELECT doc_id, {fillers_sql('text')} AS text FROM s")
def t3(spark, d):
    return spiced(spark, d, FILLED).select("doc_id", text.without_fillers(F.col("text")).alias("text"))


#: Marks have no space before them and one after where a word follows, brackets the other way round; RE2 has no look-ahead, so the letter after is put back.
SPACING_SQL = [("[ \\t]+", " "), (" +([,.;:!?…»%)\\]])", "\\1"), ("([(\\[«]) +", "\\1"), ("([,;:!?…])([A-Za-zÀ-ÿ0-9])", "\\1 \\2"), ("(\\.)([A-ZÀ-Ÿ])", "\\1 \\2"), ("[ \\t]+", " "), ("\n[ \\t]+", "\n"), ("[ \\t]+\n", "\n"), ("\n{3,}", "\n\n"), ("^\\s+|\\s+$", "")]


def spacing_sql(column: str) -> str:
    for p, to in SPACING_SQL:
        column = f"regexp_replace({column}, {quoted(p)}, {quoted(to)}, 'g')"
    return column


@query("t4_spacing", f"SELECT doc_id, {spacing_sql('text')} AS text FROM documents")
def t4(spark, d):
    return docs(spark, d).select("doc_id", text.spaced(F.col("text")).alias("text"))


#: The capitals of a column t, but for the first.
CAPITALS_SQL = "array_to_string(list_transform(regexp_extract_all(t, '[.!?]\\s[a-zà-ÿ]|\\n[a-zà-ÿ]|[^.!?\\n]+|[.!?\\n]'), lambda x: CASE WHEN regexp_matches(x, '^(?:[.!?]\\s|\\n).') THEN upper(x) ELSE x END), '')"


@query("t5_capitals", f"WITH w AS (SELECT doc_id, {CAPITALS_SQL} AS u FROM (SELECT doc_id, lower(text) AS t FROM documents)) SELECT doc_id, upper(left(u, 1)) || substr(u, 2) AS text FROM w")
def t5(spark, d):
    return docs(spark, d).select("doc_id", text.capitalised(F.lower("text")).alias("text"))


@query("t6_formatted", f"""WITH f AS (SELECT doc_id, {spacing_sql(fillers_sql("coalesce(text, '')"))} AS t FROM documents), c AS (SELECT doc_id, {CAPITALS_SQL} AS u FROM f),
    x AS (SELECT doc_id, {spacing_sql('upper(left(u, 1)) || substr(u, 2)')} AS t FROM c) SELECT doc_id, CASE WHEN t <> '' AND NOT contains(t, chr(10)) AND NOT regexp_matches(t, '[.!?…»]$') THEN t || '.' ELSE t END AS text FROM x""")  # fmt: skip
def t6(spark, d):
    return docs(spark, d).select("doc_id", text.formatted(F.col("text")).alias("text"))


@query("t7_commands")
def t7(spark, d):
    return spiced(spark, d, ["ok à la ligne puis", "nouveau paragraphe.", "virgule", "point d'interrogation"]).select("doc_id", text.commands(F.col("text")).alias("text"))


NOISE = ["Thanks for watching", "amara.org", "www.example.com.", "[musique]", "www.example ends."]


#: Written out for DuckDB, apart from the library's phrases.
BOILERPLATE_SQL = [
    "sous[- ]titres?\\s+r[ée]alis[ée]s?\\s+par.*", "sous[- ]titres?\\s*:.*", "merci\\s+d['’]avoir\\s+regard[ée].*", "sous[- ]titrage\\s+mfp.*", "sous[- ]titrage\\s*:\\s*soci[ée]t[ée]\\s+radio[- ]canada.*",
    "thanks?\\s+for\\s+watching.*", "thank\\s+you\\s+for\\s+watching.*", "subtitles?\\s+by.*", "soustitreur\\.com", "amara\\.org", "communaut[ée]\\s+d['’]amara", "communaut[ée]\\s+amara",
    "\\[?\\s*musique\\s*\\]?", "\\[?\\s*applaudissements\\s*\\]?", "\\[?\\s*rires\\s*\\]?", "♪+", "www\\.\\S+\\.\\w+",
]


@query("t8_boilerplate", f"WITH {spiced_sql(NOISE)} SELECT doc_id, {replaced_sql('text', BOILERPLATE_SQL)} AS text FROM s")
def t8(spark, d):
    return spiced(spark, d, NOISE).select("doc_id", text.without_boilerplate(F.col("text")).alias("text"))


def without_repeats_sql(source: str) -> str:
    """CTEs that end in r (doc_id, text): of the sentences of ``source`` (doc_id, text) those that don't repeat an earlier one of over five words."""
    return f"""c AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS c FROM {source}),
    p AS (SELECT doc_id, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM c), k AS (SELECT *, trim(regexp_replace(lower(x), '\\s+', ' ', 'g')) AS n FROM p),
    o AS (SELECT *, row_number() OVER (PARTITION BY doc_id, n ORDER BY i) AS nth FROM k), r AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS text FROM o WHERE nth = 1 OR len(string_split(n, ' ')) <= 5 GROUP BY 1)"""


@query("t9_repeated_sentences", f"WITH {without_repeats_sql('documents')} SELECT doc_id, r.text FROM documents LEFT JOIN r USING (doc_id)")
def t9(spark, d):
    return docs(spark, d).select("doc_id", text.without_repeats(F.col("text")).alias("text"))


TIDY_SQL = "regexp_replace(regexp_replace(regexp_replace({0}, '\\s+([,.;:!?…])', '\\1', 'g'), '\\s\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"


@query("t10_hallucinations", f"WITH {spiced_sql(NOISE)}, b AS (SELECT doc_id, coalesce({replaced_sql('text', BOILERPLATE_SQL)}, '') AS text FROM s), {without_repeats_sql('b')} SELECT doc_id, {TIDY_SQL.format('r.text')} AS text FROM b JOIN r USING (doc_id)")
def t10(spark, d):
    return spiced(spark, d, NOISE).select("doc_id", text.without_hallucinations(F.col("text")).alias("text"))


@query("t11_loops")
def t11(spark, d):
    return spiced(spark, d, ["la " * 12, "yes, " * 7, "one two"]).select("doc_id", text.without_loops(F.col("text")).alias("text"), text.scrubbed(F.col("text")).alias("scrubbed"))


META = ["Transcription en français.", "le mot de l uk", "merci d’avoir suivi la réunion. Suite", "hello"]


#: Written out for DuckDB, apart from the library's phrases.
METATEXT_SQL = [
    "transcription\\s+en\\s+fran[çc]ais", "termes?\\s+propres?\\s+au\\s+contexte[^.]*", "le\\s+mot\\s+de\\s+l['’]uk", "sous[- ]titres?\\s+r[ée]alis[ée]s?\\s+par[^.]*", "sous[- ]titres?\\s*:[^.]*",
    "merci\\s+d['’]avoir\\s+regard[ée][^.]*", "merci\\s+d['’]avoir\\s+suivi[^.]*", "sous[- ]titrage[^.]*",
]


def metatext_sql() -> str:
    """A step per pattern: the text without it, and how many non-blank pieces went."""
    steps = ["s0 AS (SELECT doc_id, text AS t, 0 AS r FROM s)"]
    for i, p in enumerate(METATEXT_SQL):
        q = quoted("(?i)" + p + r"\s*\.?")
        steps.append(f"s{i + 1} AS (SELECT doc_id, regexp_replace(t, {q}, ' ', 'g') AS t, r + len(list_filter(regexp_extract_all(t, {q}), lambda x: trim(x) <> '')) AS r FROM s{i})")
    return ", ".join(steps)


@query("t12_metatext", f"""WITH {spiced_sql(META)}, {metatext_sql()} SELECT doc_id, regexp_replace(regexp_replace(t, '\\s\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text, CAST(r AS INTEGER) AS removed FROM s{len(METATEXT_SQL)}""")
def t12(spark, d):
    m = text.without_metatext(F.col("text"))
    return spiced(spark, d, META).select("doc_id", m.alias("m")).select("doc_id", "m.text", F.size("m.removed").alias("removed"))


def windows(spark, d, pattern: str):
    """(doc_id, i, x): every whole text's words, a row for each 14 of them with the 40 from there on. Words are cut before rows are made, so that no row carries its whole text."""
    x = F.split(F.trim(F.regexp_replace(F.lower("text"), pattern, " ")), " +")
    cuts = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 14).cast("int")), lambda i: F.struct(i.alias("i"), F.slice(x, i * 14 + 1, F.lit(40)).alias("x")))
    w = table(spark, d, "documents").where("text is not null").select("doc_id", F.explode(text.let(x, cuts)).alias("w"))
    return w.select("doc_id", "w.i", "w.x")


def cut(at, n: int):
    return F.slice(F.col("x"), at, F.lit(n))


@query("t13_overlap", """WITH w AS (SELECT doc_id, string_split_regex(trim(regexp_replace(lower(text), '[^a-zß-öø-ÿ ]+', ' ', 'g')), ' +') AS x FROM documents WHERE text IS NOT NULL),
    i AS (SELECT doc_id, x, unnest(range(0, (len(x) - 1) // 14 + 1)) AS i FROM w),
    p AS (SELECT doc_id, i, x[14 * i + 1:14 * i + 20] AS a, x[14 * i + 13 + (doc_id + i) % 9:14 * i + 32 + (doc_id + i) % 9] AS b FROM i)
    SELECT doc_id, CAST(i AS INTEGER) AS i, coalesce(list_max(list_filter(range(3, 9), lambda k: k <= len(a) AND k <= len(b) AND a[len(a) - k + 1:] = b[:k])), 0)::INTEGER AS n FROM p""")  # fmt: skip
def t13(spark, d):
    """Windows of 20 words of every whole text, each with one that starts 12 to 20 words later."""
    return windows(spark, d, "[^a-zß-öø-ÿ ]+").select("doc_id", "i", text.overlap(cut(F.lit(1), 20), cut(13 + F.pmod(F.col("doc_id") + F.col("i"), F.lit(9)).cast("int"), 20)).alias("n"))


@query("t14_joined_windows")
def t14(spark, d):
    """Windows of 20 words of every whole text, each joined with the next, which shares 6 words with it, or starts with a word that completes its cut-off last one."""
    at, b = F.lit(1), cut(F.lit(15), 20)
    a = F.when(F.col("i") % 3 == 0, cut(at, 20)).when(F.col("i") % 3 == 1, F.concat(cut(at, 14), F.array(F.left(F.coalesce(F.get(b, F.lit(0)), F.lit("")), F.lit(2))))).otherwise(F.concat(cut(at, 20), F.array(F.lit("un"))))
    return windows(spark, d, "[^a-zß-öø-ÿ ]+").select("doc_id", "i", F.array_join(text.joined(a, b), " ").alias("text"))


@query("t15_merged_windows")
def t15(spark, d):
    """A conversation's turns as windows; a running accumulator over the ordered array."""
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t.text).alias("w"))
    return turns.select("conv_id", text.merged(F.col("w")).alias("text"))


@query("t16_assembled", """SELECT conv_id, trim(regexp_replace(regexp_replace(regexp_replace(string_agg(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ' ORDER BY turn), '\\s+', ' ', 'g'), '\\s+([,.;:!?…)\\]»%])', '\\1', 'g'), '([(\\[«])\\s+', '\\1', 'g')) AS text FROM conversations WHERE trim(text) <> '' GROUP BY 1""")
def t16(spark, d):
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda t: t.text).alias("w"))
    return turns.select("conv_id", text.assembled(F.col("w")).alias("text"))


@query("t17_word_count", "SELECT doc_id, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS n FROM documents")
def t17(spark, d):
    return docs(spark, d).select("doc_id", text.word_count(F.col("text")).alias("n"))


@query("t19_normalised", "SELECT doc_id, trim(regexp_replace(translate(lower(text), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '\\s+', ' ', 'g')) AS text FROM documents")
def t19(spark, d):
    """T19 and T20 for the letters of the fixed map."""
    return docs(spark, d).select("doc_id", F.trim(F.regexp_replace(text.folded(F.col("text")), r"\s+", " ")).alias("text"))


@query("t21_safe_title", "SELECT doc_id, coalesce(nullif(rtrim(left(trim(regexp_replace(regexp_replace(CASE doc_id % 5 WHEN 0 THEN ' ?? ' WHEN 1 THEN '#[a] ^b: ' || text ELSE text END, '[\\\\/:*?\"<>|\\n\\r\\t]+', ' ', 'g'), '\\s+', ' ', 'g')), 60)), ''), 'Réunion') AS title FROM documents")
def t21(spark, d):
    """Some texts have nothing that a title may hold, some start with signs that it may."""
    k, t = F.col("doc_id") % 5, F.col("text")
    return docs(spark, d).select("doc_id", text.safe_title(F.when(k == 0, " ?? ").when(k == 1, F.concat(F.lit("#[a] ^b: "), t)).otherwise(t)).alias("title"))


@query("t22_notice", "SELECT doc_id, left(trim(regexp_replace(regexp_replace(chr(9) || 'a' || chr(127) || 'b ' || text, '[\\x00-\\x1F]+', ' ', 'g'), '\\s+', ' ', 'g')), 240) AS notice FROM documents")
def t22(spark, d):
    return docs(spark, d).select("doc_id", text.notice(F.concat(F.lit("\ta\x7fb "), "text")).alias("notice"))


@query("t23_preview", "SELECT doc_id, left(text, 140) AS preview FROM documents")
def t23(spark, d):
    return docs(spark, d).select("doc_id", F.substring("text", 1, 140).alias("preview"))


@query("t24_labels", "SELECT vec_id, printf('SPEAKER_%02d', label) AS speaker, 'Voix ' || (label + 1) AS name FROM embeddings")
def t24(spark, d):
    from ..operators.export import speaker_label

    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("SPEAKER_"), F.lpad(F.col("label").cast("string"), 2, "0")).alias("speaker"))
    return e.select("vec_id", "speaker", speaker_label(F.col("speaker")).alias("name"))


BUCKETS = [("work", ["the", "of", "and"]), ("home", ["le", "la", "les"]), ("trips", ["der", "die", "und"])]


def _score(keys: list[str]) -> str:
    return " + ".join(f"CAST(regexp_matches(t, '(^|[^a-zß-ÿ0-9_]){k}($|[^a-zß-ÿ0-9_])') AS INT)" for k in keys)


@query("t25_routing", f"""WITH n AS (SELECT doc_id, translate(lower(text), 'àâäáãåçéèêëíìîïñóòôöõúùûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy') AS t FROM documents),
    s AS (SELECT doc_id, {_score(BUCKETS[0][1])} AS a, {_score(BUCKETS[1][1])} AS b, {_score(BUCKETS[2][1])} AS c FROM n)
    SELECT doc_id, CASE WHEN greatest(a, b, c) = 0 THEN 'inbox' WHEN a >= b AND a >= c THEN 'work' WHEN b >= c THEN 'home' ELSE 'trips' END AS bucket FROM s""")  # fmt: skip
def t25(spark, d):
    """Keywords present, the highest count wins."""
    x = docs(spark, d)
    return x.select("doc_id", text.routed(x, "text", BUCKETS, "inbox").alias("bucket"))


@query("t26_segment_words", """WITH t AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '') AS w FROM conversations), x AS (SELECT conv_id, turn, len(w) AS n, unnest(w) AS tok, generate_subscripts(w, 1) - 1 AS i FROM t)
    SELECT conv_id, turn AS ord, CAST(i AS INTEGER) AS i, ' ' || tok AS word, round(turn * 10 + i * 8.0 / n, 6)::DOUBLE AS start, round(turn * 10 + (i + 1) * 8.0 / n, 6)::DOUBLE AS "end" FROM x""")  # fmt: skip
def t26(spark, d):
    seg = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), (F.col("turn") * 10.0).alias("start"), (F.col("turn") * 10.0 + 8).alias("end"), "text")
    return text.segment_words(seg, ["conv_id"]).withColumns({c: F.round(c, 6) for c in ("start", "end")})


CREDITED = ["Thanks for Watching", "amara.org", "hello", "sous-titrage MFP"]


#: Written out for DuckDB, apart from the library's list.
CREDITED_SQL = "(amara\\.org|communauté (d''amara|amara)|sous-titrage (mfp|: société radio-canada)|soustitreur\\.com|merci d''avoir regardé|(thanks|thank you) for watching|subtitles? by)"


@query("p14_hallucinated", f"WITH {spiced_sql(CREDITED)} SELECT doc_id, CASE WHEN regexp_matches(lower(text), '{CREDITED_SQL}') THEN '' ELSE text END AS text FROM s")
def p14(spark, d):
    return spiced(spark, d, CREDITED).select("doc_id", F.when(text.hallucinated(F.col("text")), "").otherwise(F.col("text")).alias("text"))


@query("s10_terms", "SELECT DISTINCT trim(p_type) AS term FROM part WHERE trim(p_type) <> '' AND NOT starts_with(trim(p_type), '#')")
def s10(spark, d):
    return table(spark, d, "part").select(F.trim("p_type").alias("term")).where("term <> '' and not startswith(term, '#')").distinct()


@query("s19_csv_column", "SELECT DISTINCT lower(c_mktsegment) AS email FROM customer WHERE lower(c_mktsegment) <> 'machinery'")
def s19(spark, d):
    lines = table(spark, d, "customer").select(F.concat_ws(",", "c_custkey", "c_mktsegment").alias("line"))
    return lines.select(F.from_csv("line", "id long, email string").alias("r")).select(F.lower("r.email").alias("email")).where("email <> 'machinery'").distinct()


@query("w24_first_seen", "SELECT p_size, arg_min(p_type, p_partkey) AS term, min(p_partkey) AS ord FROM (SELECT p_size, lower(p_type) AS k, p_type, p_partkey FROM part) GROUP BY p_size, k")
def w24(spark, d):
    w = Window.partitionBy("p_size", F.lower("p_type")).orderBy("p_partkey")
    return table(spark, d, "part").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("p_size", F.col("p_type").alias("term"), F.col("p_partkey").alias("ord"))


@query("w25_bounded_list", """WITH t AS (SELECT p_size, p_name, p_partkey, sum(length(p_name)) OVER w + 2 * (count(*) OVER w - 1) AS upto FROM part WINDOW w AS (PARTITION BY p_size ORDER BY p_partkey ROWS UNBOUNDED PRECEDING))
    SELECT p_size, string_agg(p_name, ', ' ORDER BY p_partkey) AS terms FROM t WHERE upto <= 380 GROUP BY 1""")  # fmt: skip
def w25(spark, d):
    """Terms until the first that doesn't fit: the running length only grows, so none after it fits either."""
    w = Window.partitionBy("p_size").orderBy("p_partkey").rowsBetween(Window.unboundedPreceding, 0)
    t = table(spark, d, "part").withColumn("upto", F.sum(F.char_length("p_name")).over(w) + 2 * (F.count("*").over(w) - 1)).where("upto <= 380")
    return t.groupBy("p_size").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x.p_name), ", ").alias("terms"))
