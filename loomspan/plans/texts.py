"""Queries of text functions, time phrases, facts and transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspan.functions import chunking, facts, providers, text, timephrase
from loomspan.operators import notes, transcript
from loomspan.session import table

TODAY = "2026-08-22"
PHRASES = [
    ("geçen haftaki toplantı notları", "2026-08-10", "2026-08-16", "toplantı notları"), ("bu haftaki toplantı", "2026-08-17", "2026-08-23", "toplantı"),
    ("dün gelen dilekçe", "2026-08-21", "2026-08-21", "gelen dilekçe"), ("geçen ay proje raporu", "2026-07-01", "2026-07-31", "proje raporu"),
    ("ağustos bütçe", "2026-08-01", "2026-08-31", "bütçe"), ("son 3 gün fatura", "2026-08-19", "2026-08-22", "fatura"), ("geçen yıl sözleşme", "2025-01-01", "2025-12-31", "sözleşme"),
    ("son 2 haftadaki  işler", "2026-08-08", "2026-08-22", "işler"), ("bugün ne var", "2026-08-22", "2026-08-22", "ne var"), ("önceki gün", "2026-08-20", "2026-08-20", ""),
    ("bu ay ayakkabı", "2026-08-01", "2026-08-31", "ayakkabı"), ("bu yıl bütçe", "2026-01-01", "2026-12-31", "bütçe"), ("aralık raporu", "2025-12-01", "2025-12-31", "raporu"),
    ("gecen sene", None, None, "gecen sene"), ("izin   dilekçesi", None, None, "izin dilekçesi"),
]
GERMAN, ENGLISH = "Montag Dienstag Mittwoch Donnerstag Freitag Samstag Sonntag".split(), "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split()


def _digest(parts: str) -> Column:
    return F.sha2(F.array_join(parts, "\x1f"), 256)


def exact_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(text.exact_terms(F.col("text")), "|").alias("terms"))


def sentence_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", text.sentences(F.col("text")).alias("s"))
    return d.select("doc_id", F.size("s").alias("sentences"), _digest("s").alias("sha256"))


def spoken_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "conversations").select("conv_id", "turn", text.spoken_sentences(F.col("text")).alias("s"))
    return d.select("conv_id", "turn", F.size("s").alias("sentences"), _digest("s").alias("sha256"))


def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(chunking.chunker()(F.col("text"))).alias("no", "chunk"))
    return d.select("doc_id", "no", F.size(text.words(F.col("chunk"))).alias("words"), F.sha2("chunk", 256).alias("sha256"))


def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", text.html_strip(F.col("html")).alias("t"))
    return p.select("page_id", F.length("t").cast("bigint").alias("chars"), F.sha2("t", 256).alias("sha256"))


def time_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = spark.createDataFrame([(p[0],) for p in PHRASES], "phrase string")
    return asked.select("phrase", timephrase.parse(F.col("phrase"), F.lit(TODAY).cast("date")).alias("t")).select("phrase", F.col("t.start").alias("start_day"), F.col("t.end").alias("end_day"), F.col("t.rest").alias("rest"))


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event's time told in German and in English, the latter with another day at times."""
    e = table(spark, sf_dir, "events").select("event_id", F.weekday("ts").alias("day"), F.hour("ts").alias("hour"))
    name = lambda names, d: F.element_at(F.array(*map(F.lit, names)), d + 1)
    moved = F.when(F.col("event_id") % 10 == 0, (F.col("day") + 1) % 7).otherwise(F.col("day")).cast("int")
    return e.withColumn("said", F.concat(F.lit("bis "), name(GERMAN, F.col("day")), F.lit(", "), F.col("hour"), F.lit(" Uhr"))).withColumn("told", F.concat(F.lit("until "), name(ENGLISH, moved), F.lit(", "), F.col("hour"), F.lit(":00")))


def fact_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("event_id", F.array_join(facts.weekdays(F.col("said")), ",").alias("said_days"), F.array_join(facts.weekdays(F.col("told")), ",").alias("told_days"))


def fact_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("event_id", F.array_join(facts.digit_numbers(F.col("said")), ",").alias("said_numbers"), F.array_join(facts.facts("told")["numbers"], ",").alias("told_numbers"))


def fact_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _said(spark, sf_dir).select("event_id", facts.keeps_facts("said", "told").alias("same"))


def fact_checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The English text where it keeps the facts, else with its day put right."""
    return _said(spark, sf_dir).select("event_id", facts.checked("en")(F.col("said"), F.col("told"), F.lit(None).cast("string")).alias("shown"))


def unsaid_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words for days in the notes of a user's hour that none of its originals has."""
    s = _said(spark, sf_dir).join(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id").withColumn("session", F.col("user_id") * 100 + F.col("hour"))
    # equal lines name the same: each is written once, so that notes do not grow with repetition
    written = s.groupBy("session").agg(F.array_join(F.array_sort(F.collect_set("told")), "\n").alias("notes"))
    found = notes.audit(written, s.select("session", "said"))
    return found.where((F.size("words") > 0) | (F.size("numbers") > 0)).select("session", F.array_join("words", ",").alias("words"), F.array_join("numbers", ",").alias("numbers"))


def _told(spark: SparkSession, sf_dir: str, examples: list[tuple]) -> DataFrame:
    """Every event with one of the examples' texts, by its number."""
    said = F.element_at(F.array(*[F.lit(x[0]) for x in examples]), (F.col("event_id") % len(examples) + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("event of "), said).alias("said"))


def _listed(kind: str, examples: list[tuple]):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _told(spark, sf_dir, examples).select("event_id", F.array_join(facts.facts("said")[kind], ",").alias("found"))

    return query


#: Texts with what they name, in order: days from today, numbers in words, parts of the day.
RELATIVE_SAID = [("dünkü toplantı", "-1"), ("heute oder übermorgen", "0,2"), ("bis morgen früh", "1"), ("am Morgen", ""), ("yesterday. Morgen kommt er", "-1,1"), ("vorgestern, tomorrow, yarından sonra", "-2,1"), ("nothing at all", "")]
WORDS_SAID = [("saat on dörtte", "14"), ("yirmi üç kişi", "23"), ("twenty five people", "5,25"), ("vierundzwanzig Leute", "24"), ("bunu ona söyle", ""), ("sabah ona kadar", "10"), ("altıda ve yedide", "6,7"), ("thirty or forty", "30,40"), ("elli", "50")]
PARTS_SAID = [("öğleden sonra geldi", "2"), ("Freitagabend", "3"), ("morgens früh", "0"), ("in the morning or at night", "0,4"), ("gece ve sabah", "0,4"), ("Mittwochmittag", "1"), ("nothing", ""), ("öğleden önce, Nachmittag", "0,2")]
#: Hours from 13 with their Turkish dative.
DATIVES = {13: "e", 14: "e", 15: "e", 16: "ya", 17: "ye", 18: "e", 19: "a", 20: "ye", 21: "e", 22: "ye", 23: "e"}


def clock_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours of the afternoon, translated as hours of twelve, put back with their ending; where
    another number is amiss too, the fallback's text, or nothing."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 11 + 13).cast("int").alias("hour"))
    odd, none = F.col("event_id") % 7 == 0, F.col("event_id") % 14 == 0
    said = F.format_string("bis %d Uhr", "hour")
    told = F.concat(F.lit("saat "), (F.col("hour") - 12).cast("string"), F.lit("'e kadar"), F.when(odd, ", 99 kişi").otherwise(""))
    second = F.when(odd & ~none, F.concat(F.lit("saat "), F.col("hour")))
    return e.select("event_id", facts.checked("tr")(said, told, second).alias("shown"))


def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns in another language whose translation is missing or names another day, filled."""
    words = {("xx", "tr"): {"montag": "pazartesi"}}
    t = _turns(spark, sf_dir).select("conv_id", "turn", F.when(F.col("turn") % 2 == 0, "xx").otherwise("tr").alias("said_lang"), F.lit("Montag").alias("said"), F.lit("tr").alias("other_lang"))
    t = t.withColumn("translation", F.when(F.col("turn") % 4 == 0, F.lit(None)).when(F.col("turn") % 4 == 2, "salı günü").otherwise("elle"))
    return notes.fill_gaps(t, lambda: providers.dictionary_translator(words)).select("conv_id", "turn", "translation")


def languages_locked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.lock_language(_turns(spark, sf_dir).withColumn("lang", F.when(F.col("turn") > F.col("conv_id") % 3, F.col("role"))), "conv_id", "turn").select("conv_id", "turn", "lang")


def heard_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns behind a switch are heard anew."""
    again = F.struct(F.concat(F.lit("again "), F.col("said")).alias("text"), F.col("lang").alias("lang"))
    rows = transcript.heard_again(_turns(spark, sf_dir).select("conv_id", "turn", F.col("role").alias("lang"), F.col("text").alias("said")), "conv_id", "turn", again)
    return rows.select("conv_id", "turn", "switched", F.sha2("said", 256).alias("sha256"))


def caption_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a titler shows of each turn, in every style."""
    t = _turns(spark, sf_dir).withColumn("other", F.when(F.col("turn") % 2 == 1, F.concat(F.lit("xx "), F.col("text"))))
    return t.select("conv_id", "turn", *[F.sha2(transcript.caption_line(F.col("text"), F.col("other"), style), 256).alias(style.replace("-", "_")) for style in ("both", "one-line", "translation", "original")])


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))


def drop_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns that begin with the last words of the turn before, as after a cut."""
    before = F.lag("text", 1, "").over(Window.partitionBy("conv_id").orderBy("turn"))
    t = _turns(spark, sf_dir).withColumn("before", before)
    w = text.words(F.col("before"))
    n = F.least(F.size(w), (F.col("turn") % 4).cast("int"))
    tail = F.array_join(F.slice(w, F.size(w) - n + 1, n), " ")
    t = t.withColumn("heard", F.when(n > 0, F.concat(tail, F.lit(", "), F.col("text"))).otherwise(F.col("text")))
    out = F.array_join(text.words(text.drop_repeat(F.col("before"), F.col("heard"))), " ")
    return t.select("conv_id", "turn", F.sha2(out, 256).alias("sha256"))


def context_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _turns(spark, sf_dir).withColumnsRenamed({"role": "lang", "text": "said"})
    return transcript.context(rows, "conv_id", "turn").select("conv_id", "turn", F.sha2("context", 256).alias("sha256"))


def language_switches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcript.language_switches(_turns(spark, sf_dir).withColumnRenamed("role", "lang"), "conv_id", "turn").groupBy("conv_id").agg(F.sum(F.col("switched").cast("bigint")).alias("switches"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_line = F.regexp_replace("text", "[\r\n]+", " ")
    t = _turns(spark, sf_dir).select("conv_id", (F.col("turn") * 61).alias("at"), F.col("role").alias("said_lang"), one_line.alias("said"), F.lit("xx").alias("other_lang"), F.when(F.col("turn") % 2 == 1, F.concat(F.lit("xx "), one_line)).alias("translation"))
    return transcript.render(t)


def transcript_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("conv_id", "at", F.sha2("record", 256).alias("sha256"))


def transcript_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered and read back."""
    lines = _records(spark, sf_dir).select(F.col("conv_id").alias("session"), "at", F.posexplode(F.split("record", "\n")).alias("k", "line"))
    lines = lines.select("session", (F.col("at") * 10 + F.col("k")).alias("line_no"), "line")
    out = transcript.parse(lines)
    return out.select("session", "at", "said_lang", F.sha2("said", 256).alias("said"), "other_lang", F.sha2("translation", 256).alias("translation"))


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _records(spark, sf_dir).withColumnRenamed("conv_id", "session")
    return transcript.as_prompt(rows).select("session", F.sha2("prompt", 256).alias("sha256"))


QUERIES = {f.__name__: f for f in (exact_terms, sentence_split, spoken_sentences, chunk_documents, html_strip, time_ranges, fact_days, fact_numbers, fact_same, fact_checked, unsaid_audit, drop_repeat, context_window, language_switches, transcript_render, transcript_parse, prompts, clock_repair, gap_fill, languages_locked, heard_again, caption_lines)}
LISTED = {"fact_relative": ("relative", RELATIVE_SAID), "fact_number_words": ("numbers", WORDS_SAID), "fact_parts": ("parts", PARTS_SAID)}
QUERIES |= {name: _listed(*how) for name, how in LISTED.items()}

_SP = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
_STRIP = rf"'^{_SP}+|{_SP}+$', '', 'g'"
_E = f"e AS (SELECT event_id, isodow(ts) - 1 AS day, CASE WHEN event_id % 10 = 0 THEN isodow(ts) % 7 ELSE isodow(ts) - 1 END AS told, hour(ts) AS hour FROM events)"
_C = "c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations)"
_CLOCK = """printf('%02d:%02d:%02d', "at" // 3600, "at" % 3600 // 60, "at" % 60)"""
_R = f"{_C}, r AS (SELECT conv_id, turn * 61 AS \"at\", role, regexp_replace(text, '[\\r\\n]+', ' ', 'g') AS said, CASE WHEN turn % 2 = 1 THEN 'xx ' || regexp_replace(text, '[\\r\\n]+', ' ', 'g') END AS tr FROM c)"
_VALUES = ", ".join("({})".format(", ".join("NULL" if x is None else f"'{x}'" for x in p)) for p in PHRASES)


def _keep(t: str) -> str:
    """A blank behind an abbreviation set aside."""
    return rf"regexp_replace({t}, '(^|{_SP})((?i:{'|'.join(text.ABBREVIATIONS)})[.!?…]{{1,4}}){_SP}+', '\1\2' || chr(1), 'g')"


def _count(t: str) -> str:
    """The number of words of a text."""
    return rf"len(list_filter(string_split(regexp_replace({t}, '{_SP}+', ' ', 'g'), ' '), lambda w: w <> ''))"


ORACLE_SQL = {
    "exact_terms": r"""SELECT doc_id, array_to_string(list_concat(regexp_extract_all(coalesce(text, ''), '"([^"]+)"', 1), list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_./-]+'), lambda t: regexp_matches(t, '\p{Nd}') AND length(t) >= 3)), '|') AS terms FROM documents""",
    "sentence_split": rf"WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?:]){_SP}+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') AS s FROM documents) SELECT doc_id, CAST(len(s) AS INTEGER) AS sentences, sha256(coalesce(array_to_string(s, chr(31)), '')) AS sha256 FROM s",
    "html_strip": rf"WITH t AS (SELECT page_id, regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]+>', ' ', 'g'), {_STRIP}) AS t FROM pages) SELECT page_id, length(t) AS chars, sha256(t) AS sha256 FROM t",
    "time_ranges": f"SELECT phrase, CAST(a AS DATE) AS start_day, CAST(b AS DATE) AS end_day, rest FROM (VALUES {_VALUES}) AS t(phrase, a, b, rest)",
    "fact_days": f"WITH {_E} SELECT event_id, CAST(day AS VARCHAR) AS said_days, CAST(told AS VARCHAR) AS told_days FROM e",
    "fact_numbers": f"WITH {_E} SELECT event_id, CAST(hour AS VARCHAR) AS said_numbers, CAST(hour AS VARCHAR) AS told_numbers FROM e",
    "fact_same": f"WITH {_E} SELECT event_id, day = told AS same FROM e",
    "fact_checked": f"WITH {_E} SELECT event_id, 'until ' || {ENGLISH}[day + 1] || ', ' || hour || ':00' AS shown FROM e",
    "unsaid_audit": f"WITH {_E}, u AS (SELECT user_id * 100 + hour(ts) AS session, e.day, e.told FROM e JOIN events USING (event_id)), w AS (SELECT DISTINCT session, {ENGLISH}[told + 1] AS word FROM u a WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.session = a.session AND b.day = a.told)) SELECT session, string_agg(word, ',' ORDER BY word) AS words, '' AS numbers FROM w GROUP BY session",
    **{name: f"SELECT event_id, {[x[1] for x in examples]}[event_id % {len(examples)} + 1] AS found FROM events" for name, (_, examples) in LISTED.items()},
    "clock_repair": f"WITH h AS (SELECT event_id, event_id % 11 + 13 AS h FROM events) SELECT event_id, CASE WHEN event_id % 14 = 0 THEN '' WHEN event_id % 7 = 0 THEN 'saat ' || h ELSE 'saat ' || h || chr(39) || {[*DATIVES.values()]}[h - 12] || ' kadar' END AS shown FROM h",
    "gap_fill": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'pazartesi' ELSE 'elle' END AS translation FROM conversations",
    "languages_locked": "WITH l AS (SELECT conv_id, turn, CASE WHEN turn > conv_id % 3 THEN role END AS r FROM conversations), f AS (SELECT conv_id, arg_min(r, turn) AS lang FROM l WHERE r IS NOT NULL GROUP BY conv_id) SELECT conv_id, turn, lang FROM l LEFT JOIN f USING (conv_id)",
    "heard_again": f"WITH {_C}, l AS (SELECT *, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) <> role, false) AS switched FROM c) SELECT conv_id, turn, switched, sha256(CASE WHEN switched THEN 'again ' ELSE '' END || text) AS sha256 FROM l",
    "caption_lines": f"WITH {_C}, o AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 1 THEN 'xx ' || text ELSE '' END AS other FROM c) SELECT conv_id, turn, sha256(text || CASE WHEN other <> '' THEN chr(10) || other ELSE '' END) AS both, sha256(text || CASE WHEN other <> '' THEN ' — ' || other ELSE '' END) AS one_line, sha256(CASE WHEN other <> '' THEN other ELSE text END) AS translation, sha256(text) AS original FROM o",
    "spoken_sentences": rf"""WITH {_C}, a AS (SELECT conv_id, turn, regexp_replace(text, {_STRIP}) AS t FROM c),
b AS (SELECT conv_id, turn, {_keep(_keep('t'))} AS t FROM a),
s AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(t, '([.!?…]){_SP}+', '\1' || chr(31), 'g'), chr(31)), lambda x: x <> '') AS s FROM b)
SELECT conv_id, turn, CAST(len(s) AS INTEGER) AS sentences, sha256(coalesce(replace(array_to_string(s, chr(31)), chr(1), ' '), '')) AS sha256 FROM s""",
    "chunk_documents": rf"""WITH RECURSIVE d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), {_STRIP}) AS t, {_count("coalesce(text, '')")} AS n,
  list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?:]){_SP}+', '\1' || chr(10), 'g'), chr(10)), lambda x: regexp_replace(x, {_STRIP})), lambda x: x <> '') AS s FROM documents),
z AS (SELECT doc_id, s, list_transform(s, lambda x: {_count('x')}) AS z FROM d WHERE n > {chunking.MOST_WORDS}),
p AS (SELECT doc_id, s, len(s) AS k, list_transform(range(0, len(s) + 1), lambda i: coalesce(list_sum(z[:i]), 0)) AS p FROM z),
r AS (
  SELECT doc_id, 0 AS no, 0::BIGINT AS a, coalesce(list_filter(range(1, k), lambda i: p[i + 2] > {chunking.MOST_WORDS})[1], k) AS e FROM p
  UNION ALL
  SELECT doc_id, no + 1, b, coalesce(list_filter(range(e + 1, k), lambda i: p[i + 2] - p[b + 1] > {chunking.MOST_WORDS})[1], k) FROM (
    SELECT r.doc_id, r.no, r.e, p.k, p.p, coalesce(list_max(list_filter(range(r.a, r.e), lambda i: p.p[r.e + 1] - p.p[i + 1] >= {chunking.OVERLAP})), r.a) AS b FROM r JOIN p USING (doc_id) WHERE r.e < p.k)
), c AS (SELECT doc_id, no, array_to_string(s[a + 1:e], ' ') AS chunk FROM r JOIN p USING (doc_id) UNION ALL SELECT doc_id, 0, t FROM d WHERE n <= {chunking.MOST_WORDS} AND t <> '')
SELECT doc_id, CAST(no AS INTEGER) AS no, CAST({_count('chunk')} AS INTEGER) AS words, sha256(chunk) AS sha256 FROM c""",
    "drop_repeat": rf"""WITH {_C}, b AS (SELECT conv_id, turn, list_filter(string_split(regexp_replace(text, '{_SP}+', ' ', 'g'), ' '), lambda x: x <> '') AS w, list_filter(string_split(regexp_replace(coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), ''), '{_SP}+', ' ', 'g'), ' '), lambda x: x <> '') AS p FROM c),
h AS (SELECT conv_id, turn, p, list_concat(p[len(p) - least(len(p), turn % 4) + 1:], w) AS w FROM b),
k AS (SELECT conv_id, turn, w, list_transform(p, lambda x: lower(trim(x, '{text.EDGE.replace("'", "''")}'))) AS bk, list_transform(w, lambda x: lower(trim(x, '{text.EDGE.replace("'", "''")}'))) AS hk FROM h)
SELECT conv_id, turn, sha256(coalesce(array_to_string(w[list_max(list_filter(range(0, 9), lambda n: n <= len(bk) AND n <= len(hk) AND bk[len(bk) - n + 1:] = hk[1:n])) + 1:], ' '), '')) AS sha256 FROM k""",
    "context_window": f"WITH {_C} SELECT conv_id, turn, sha256(coalesce(string_agg('(' || role || ') ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), '')) AS sha256 FROM c",
    "language_switches": "WITH l AS (SELECT conv_id, role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM conversations) SELECT conv_id, CAST(coalesce(sum(s::INT), 0) AS BIGINT) AS switches FROM l GROUP BY conv_id",
    "transcript_render": f"WITH {_R} SELECT conv_id, \"at\", sha256('[' || {_CLOCK} || '] (' || role || ') ' || said || chr(10) || CASE WHEN coalesce(tr, '') <> '' THEN '           (xx) ' || tr || chr(10) ELSE '' END || chr(10)) AS sha256 FROM r",
    "transcript_parse": f"WITH {_R} SELECT conv_id AS session, \"at\", role AS said_lang, sha256(said) AS said, CASE WHEN coalesce(tr, '') <> '' THEN 'xx' END AS other_lang, sha256(nullif(tr, '')) AS translation FROM r",
    "prompts": f"WITH {_R} SELECT conv_id AS session, sha256(string_agg('[' || {_CLOCK} || '] (' || role || ') ' || said, chr(10) ORDER BY \"at\")) AS sha256 FROM r GROUP BY conv_id",
}
