"""Search terms, searches with context, and claims about files, formats and columns that a task and its rubric make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import let

# Words that say nothing about a source, and the patterns of terms and claims; equal results need equal ones.
STOPWORDS = (
    "about", "after", "also", "and", "available", "before", "company", "correctly", "data", "does", "field", "file", "from", "have", "include", "includes", "input", "into", "list", "listed", "manual",
    "must", "output", "provided", "required", "rubric", "shall", "should", "source", "that", "the", "their", "these", "this", "those", "with",
)
NUMBER = r"(?U)\b\d[\d,]*(?:\.\d+)?%?\b"
QUOTED_FILE = r"""(?i)["'‘’“”]([^"'‘’“”\r\n]{1,240}\.(?:docx?|xlsx?|xlsm|pdf|pptx?|csv|txt|md|zip|png|jpe?g|wav|mp3|mp4|ipynb|py|ya?ml))["'‘’“”]"""
REFERENCE_CUE = r"(?i)\b(?:reference|source|attached|input)\s+(?:sheet|file|document|workbook|spreadsheet|script|template)|\b(?:copy\s+of|consistent\s+with|based\s+on|other\s+than|uses?)\s+(?:the\s+)?$"
OUTPUT_CUE = r"(?i)\b(?:save(?:d)?|file\s*name|filename|deliverable|return|submit|attach|label\s+the\s+final|titled|provided\s+as|create(?:d)?|compile)\b"
EXACT_CUE = r"(?i)\b(?:file\s*name|filename)\b[^.]{0,80}\bexact(?:ly)?\b|\bexact(?:ly)?\b[^.]{0,80}\b(?:file\s*name|filename)\b|\bsave(?:d)?\s+(?:the\s+\w+\s+)?(?:exactly\s+)?as\b|\blabel\s+the\s+final\b|\bfollowing\s+file\s*name\b"
FORMATS = {
    ".docx": r"(?i)\bWord\b(?:\s+(?:document|file))?|\.docx\b",
    ".xlsx": r"(?i)\bExcel\s+(?:workbook|file|spreadsheet)\b|\.xlsx\b",
    ".pdf": r"(?i)\bPDF\b(?:\s+(?:document|file))?|\.pdf\b",
    ".pptx": r"(?i)\bPowerPoint\s+file\b|\.pptx\b",
}
FINAL_PDF = r"(?i)(?:convert(?:ed)?\s+(?:it|them)?\s*to|as|final\s+)\s*(?:a\s+)?PDF\b"
COLUMN_ROLES = {
    "variance": (r"(?i)column\s+([A-Z]{1,3})[^.]{0,100}?(?:variance|quarter[\s‑–-]*on[\s‑–-]*quarter)", r"(?i)(?:variance|quarter[\s‑–-]*on[\s‑–-]*quarter)[^.]{0,100}?column\s+([A-Z]{1,3})", r"(?i)(?:absolute\s+)?variance\s*\|([A-Z]{1,3})\|"),
    "sample_flag": (r"(?i)column\s+([A-Z]{1,3})[^.]{0,100}?(?:sampled|sample\s+(?:flag|selected|selection))", r"(?i)(?:sampled|sample\s+(?:flag|selected|selection))[^.]{0,100}?column\s+([A-Z]{1,3})", r"(?i)sum\s+of\s+1s?\s+in\s+column\s+([A-Z]{1,3})"),
}
QUARTER_PAIRS = (r"(?i)Q2(?:\s+\d{4})?\s+and\s+Q3(?:\s+\d{4})?[^.]{0,80}?columns?\s+([A-Z]{1,3})\s+and\s+([A-Z]{1,3})", r"(?i)columns?\s+([A-Z]{1,3})\s+and\s+([A-Z]{1,3})[^.]{0,100}?Q2(?:\s+\d{4})?\s+and\s+Q3(?:\s+\d{4})?[^.]{0,30}?respectively")
CONDITION = r"(?i)\b(?:if|unless|depending on|where)\b"
SCOPE_WORDS = (("deliverable:sample_size_calculation", "sample size calculation"), ("deliverable:first_sheet", "first worksheet|first tab|selected sample"), ("reference:population", "population reference|population sheet"))
QUOTED_SHEET = (r"""(?i)(?:worksheet|sheet|tab)\s+["'‘’“”]([^"'‘’“”]{1,60})["'‘’“”]""", r"""(?i)["'‘’“”]([^"'‘’“”]{1,60})["'‘’“”]\s+(?:worksheet|sheet|tab)""")
NAMED_SHEET = ((r"(?i)\b(?:on|in|within)\s+(?:the\s+)?([A-Za-z0-9_-]{1,40})\s+(?:worksheet|sheet|tab)\b", ("first", "selected")), (r"(?i)\b([A-Za-z0-9_-]{1,40})\s+(?:worksheet|sheet|tab)\b", ("first", "selected", "population", "reference")))
TASK_SCOPES = (("deliverable:first_sheet", "capture|indicate sampled|marked in column"), ("reference:population", "q2 and q3 data"))


def spaced(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "))


def _all(x: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), group)


def _first_of_each(terms: Column, key, most: int) -> Column:
    """terms without those whose key came before or is empty, `most` at most."""
    keyed = F.transform(terms, key)
    return F.slice(F.filter(terms, lambda t, i: (F.get(keyed, i) != "") & (F.array_position(keyed, F.get(keyed, i)) == i + 1)), 1, most)


def _with_bare(numbers: Column) -> Column:
    return F.flatten(F.transform(numbers, lambda n: F.when(F.endswith(n, F.lit("%")), F.array(n, F.regexp_replace(n, "%$", ""))).otherwise(F.array(n))))


def required_terms(required: Column, rubric: Column, most: int = 64) -> Column:
    """Terms to look for: of each required phrase and the rubric the phrase itself (from 3 characters), its numbers (those with
    a per cent sign also without) and its words that aren't stop words; each once, ignoring case, in order, `most` at most."""
    phrases = F.transform(F.concat(F.coalesce(required, F.array().cast("array<string>")), F.array(F.coalesce(rubric, F.lit("")))), lambda p: spaced(F.translate(p, "_-", "  ")))
    words = lambda p: F.filter(_all(p, r"[A-Za-z][A-Za-z0-9]{3,}|[一-鿿]{2,}"), lambda w: ~F.lower(w).isin(*STOPWORDS))
    every = F.flatten(F.transform(phrases, lambda p: F.concat(F.when(F.length(p) >= 3, F.array(p)).otherwise(F.array().cast("array<string>")), _with_bare(_all(p, NUMBER)), words(p))))
    return let(every, lambda ts: _first_of_each(ts, F.lower, most))


def grounding_terms(rubric: Column, most: int = 48) -> Column:
    """Details of a rubric that its sources might ground: quoted strings, numbers, file names (with and without their folder) and
    longer words; each once by its letters and digits, in that order, `most` at most."""
    files = r"(?i)\b[\w./ -]+\.(?:md|txt|csv|tsv|xlsx|xls|docx|doc|pdf|pptx|ppt|json|html|htm|png|jpg|jpeg|svg|zip)\b"
    text = spaced(rubric)
    named = F.flatten(F.transform(F.transform(_all(text, files), lambda f: F.trim(f)), lambda f: F.array(f, F.regexp_extract(f, r"([^/]*)/*$", 1))))
    words = F.filter(_all(text, r"[A-Za-z][A-Za-z0-9_-]{4,}|[一-鿿]{2,}"), lambda w: ~F.lower(w).isin(*STOPWORDS))
    every = F.concat(_all(text, r"""[`'"]([^`'"]{2,120})[`'"]""", 1), _with_bare(_all(text, NUMBER)), named, words)
    return let(every, lambda ts: _first_of_each(ts, lambda t: F.regexp_replace(F.lower(t), r"(?U)[\W_]+", ""), most))


def snippets(text: Column, terms: Column, before: int = 40, after: int = 60) -> Column:
    """array<struct<term, at, snippet>>: where each term first stands in a text, ignoring case, with the characters around its start;
    at and snippet are null where it doesn't. Line feeds in a snippet are blanks. A null text has nothing; null terms are left out."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def one(t: Column) -> Column:
        at = F.instr(low, F.lower(t)) - 1
        start = F.greatest(at - before, F.lit(0))
        around = F.translate(F.substr(text, start + 1, at + after - start), "\n", " ")
        return F.struct(t.alias("term"), F.when(at >= 0, at).alias("at"), F.when(at >= 0, around).alias("snippet"))

    return F.transform(F.array_compact(terms), one)


WORDS = r"[\p{L}\p{N}]+"


def folded(x: Column) -> Column:
    """Lower case, letter by letter: any capital sigma is a medial one, a dotted capital I a plain i, so that words don't depend on
    what stands around them and places stay."""
    return F.lower(F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("Σ"), F.lit("σ")), F.lit("İ"), F.lit("i")))


def words(x: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return _all(folded(x), WORDS)


def phrase_hits(documents: DataFrame, terms: DataFrame) -> DataFrame:
    """(term_id, doc_id, hits, at, snippet): documents that hold a term as a run of whole words, ignoring case (of all scripts) and
    whatever stands between the words; hits counts the runs that don't overlap, at is the first one's place.

    A posting table (word, document) of the terms' own words is built in one pass over the texts; it gives each word's
    frequency, and a phrase is joined on its rarest word alone, so that frequent words never become keys. Only the documents
    found so are read again, to verify and to cut the context. Words of equal frequency: the first by name. Terms without
    words find nothing; null texts hold nothing; a repeated doc_id is a document each time, and its hits repeat; so do those of
    a repeated term. Null ids are ids like others.
    """
    wanted = terms.select("term_id", words(F.col("term")).alias("words")).where("size(words) > 0")
    phrases = wanted.select("words").distinct()
    vocabulary = phrases.select(F.explode("words").alias("word")).distinct()
    postings = documents.select("doc_id", F.explode(F.array_distinct(words(F.col("text")))).alias("word")).join(vocabulary, "word", "left_semi")
    rarity = postings.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    ranked = phrases.select("words", F.explode(F.array_distinct("words")).alias("word")).join(rarity, "word", "left")
    key = ranked.groupBy("words").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("least")).where("least.n > 0")
    pairs = key.select("words", F.col("least.word").alias("word")).join(postings, "word").select("words", F.col("doc_id").alias("id")).distinct()
    found = pairs.join(documents.select("doc_id", "text"), F.col("id").eqNullSafe(F.col("doc_id"))).withColumn("low", folded(F.col("text")))
    run = F.concat(F.lit(r"(?<![\p{L}\p{N}])"), F.array_join("words", r"[^\p{L}\p{N}]+"), F.lit(r"(?![\p{L}\p{N}])"))
    met = found.withColumn("hits", F.regexp_count("low", run)).where("hits > 0").withColumn("at", F.regexp_instr("low", run) - 1)
    around = lambda at: F.translate(F.substr(F.col("text"), F.greatest(at - 40, F.lit(0)) + 1, at + 60 - F.greatest(at - 40, F.lit(0))), "\n", " ")
    return met.join(wanted, "words").select("term_id", "doc_id", "hits", "at", around(F.col("at")).alias("snippet"))


def filename_claims(text: Column) -> Column:
    """array<struct<role, name, at, policy>> of quoted file names: reference or deliverable by the nearest cue before it (a
    deliverable also by a cue elsewhere around it; without any cue there is no claim). policy is exact where the words around
    ask for that very name or it has two endings. The name is without its folder."""
    spots = F.regexp_extract_all(text, F.lit(QUOTED_FILE), 0)
    whole = F.coalesce(text, F.lit(""))

    def last(x: Column, cue: str) -> Column:
        """Where the last cue starts; -1 without one."""
        ahead = F.regexp_instr(x, F.lit(cue))
        tail = F.aggregate(F.sequence(F.lit(1), F.regexp_count(x, F.lit(cue)) + 1), F.struct(F.lit(-1).alias("at"), F.lit(0).alias("cut")), lambda s, _: let(F.regexp_instr(F.substr(x, s["cut"] + 1), F.lit(cue)), lambda i: F.struct(F.when(i > 0, s["cut"] + i - 1).otherwise(s["at"]).alias("at"), F.when(i > 0, s["cut"] + i).otherwise(s["cut"]).alias("cut"))))
        return F.when(ahead == 0, -1).otherwise(tail["at"])

    # each quote's place: the text is cut behind one quote after the other
    placed = F.aggregate(spots, F.struct(F.lit(0).alias("cut"), F.array().cast("array<struct<quote:string,at:int>>").alias("out")), lambda s, q: let((F.instr(F.substr(whole, s["cut"] + 1), q) - 1 + s["cut"]).cast("int"), lambda at: F.struct((at + F.length(q)).alias("cut"), F.array_append(s["out"], F.struct(q.alias("quote"), at.alias("at"))).alias("out"))))["out"]

    def claim(p: Column) -> Column:
        start, end = p["at"], p["at"] + F.length(p["quote"])
        before = F.substr(whole, F.greatest(start - 80, F.lit(0)) + 1, F.least(start, F.lit(80)))
        around = F.substr(whole, F.greatest(start - 140, F.lit(0)) + 1, end + 80 - F.greatest(start - 140, F.lit(0)))
        role = let(F.struct(last(before, REFERENCE_CUE).alias("r"), last(before, OUTPUT_CUE).alias("o")), lambda n: F.when(n["r"] > n["o"], "reference").when(F.regexp_like(around, F.lit(OUTPUT_CUE)), "deliverable"))
        name = F.trim(F.regexp_extract(F.regexp_replace(F.substr(p["quote"], F.lit(2), F.length(p["quote"]) - 2), r"\\", "/"), r"([^/]*)/*$", 1))
        policy = F.when(F.regexp_like(around, F.lit(EXACT_CUE)) | F.regexp_like(name, F.lit(r"\.[A-Za-z0-9]{1,8}\.[A-Za-z0-9]{1,8}$")), "exact").otherwise("named_reference_candidate")
        return F.struct(role.alias("role"), name.alias("name"), (start + 1).alias("at"), policy.alias("policy"))

    return F.filter(F.transform(placed, claim), lambda c: c["role"].isNotNull())


def format_claims(text: Column) -> Column:
    """array<struct<fragment, extension>>: sentences that ask for an output in exactly one format. Links and quoted file names don't
    count; where several formats are named, PDF as the final form decides."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+|(?<=[.!?])\s+"), lambda p: F.trim(p)), lambda p: p != "")

    def claim(p: Column, i: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(p, r"https?://\S+", " "), QUOTED_FILE, " ")
        named = F.array_compact(F.array(*[F.when(F.regexp_like(plain, F.lit(x)), f) for f, x in FORMATS.items()]))
        one = F.when(F.size(named) == 1, F.get(named, F.lit(0))).when((F.size(named) > 1) & F.regexp_like(plain, F.lit(FINAL_PDF)), ".pdf")
        return F.struct(i.alias("fragment"), F.when(F.regexp_like(p, F.lit(OUTPUT_CUE)), one).alias("extension"))

    return F.filter(F.transform(parts, claim), lambda c: c["extension"].isNotNull())


def column_token(x: Column) -> Column:
    """A spreadsheet column's name in upper case, or null: one letter in any case, two or three in upper case, XFD at most."""
    return F.when(x.rlike("^(?:[A-Za-z]|[A-Z]{2}|[A-W][A-Z]{2}|X[A-E][A-Z]|XF[A-D])$"), F.upper(x))


def _scope(p: Column, source: str) -> Column:
    low = F.lower(p)
    scope = F.when(F.lit(False), F.lit(""))
    for name, words in SCOPE_WORDS:
        scope = scope.when(low.rlike(words), name)
    for pattern in QUOTED_SHEET:
        scope = scope.when(F.regexp_extract(p, pattern, 1) != "", F.concat(F.lit("deliverable:sheet:"), F.lower(spaced(F.regexp_extract(p, pattern, 1)))))
    for pattern, others in NAMED_SHEET:
        name = F.lower(F.regexp_extract(p, pattern, 1))
        scope = scope.when((name != "") & ~name.isin(*others), F.concat(F.lit("deliverable:sheet:"), name))
    for name, words in TASK_SCOPES if source == "task" else ():
        scope = scope.when(low.rlike(words), name)
    return scope.otherwise("unspecified")


def column_claims(text: Column, source: str) -> Column:
    """array<struct<fragment, scope, role, column, conditional>>: what a task (source "task") or rubric says about the roles of
    columns. Roles: q2 and q3 (told as a pair), variance, sample_flag. A role and column count once per sentence."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[\r\n]+|(?<=[.;])\s+(?=[A-Z0-9])"), lambda p: F.trim(p)), lambda p: p != "")
    pair_of = lambda p, pattern: F.array(column_token(F.regexp_extract(p, pattern, 1)), column_token(F.regexp_extract(p, pattern, 2)))
    both = lambda xs: F.forall(xs, lambda x: x.isNotNull())
    told = lambda role, column: F.struct(F.lit(role).alias("role"), column.alias("column"))
    told_as = lambda role: lambda c: told(role, column_token(c))
    none = F.array().cast("array<struct<role:string,column:string>>")

    def roles(p: Column) -> Column:
        pair = F.coalesce(*[F.when(both(pair_of(p, x)), pair_of(p, x)) for x in QUARTER_PAIRS])
        quarters = F.when(pair.isNotNull(), F.array(told("q2", F.get(pair, F.lit(0))), told("q3", F.get(pair, F.lit(1))))).otherwise(none)
        named = [F.transform(_all(p, x, 1), told_as(role)) for role, patterns in COLUMN_ROLES.items() for x in patterns]
        return F.array_distinct(F.filter(F.concat(quarters, *named), lambda c: c["column"].isNotNull()))

    def claims(p: Column, i: Column) -> Column:
        return F.transform(roles(p), lambda c: F.struct(i.alias("fragment"), _scope(p, source).alias("scope"), c["role"].alias("role"), c["column"].alias("column"), p.rlike(CONDITION).alias("conditional")))

    return F.flatten(F.transform(parts, claims))


def claim_rows(items: DataFrame, task: str = "task", rubric: str = "rubric") -> DataFrame:
    """(item_id, source, fragment, scope, role, column, conditional) of both texts, one row per claim."""
    of = lambda s: lambda x: F.struct(F.lit(s).alias("source"), x.alias("claim"))
    each = F.concat(*[F.transform(column_claims(F.col(c), s), of(s)) for c, s in ((task, "task"), (rubric, "rubric"))])
    return items.select("item_id", F.explode(each).alias("c")).select("item_id", "c.source", "c.claim.*")


def claim_differences(claims: DataFrame) -> DataFrame:
    """(item_id, scope, role, task_columns, rubric_columns) where task and rubric both give a role of a scope columns, and not the same
    ones. Conditional claims don't count. One grouped aggregate of small sets; an item that makes no claim twice needs no join."""
    columns = lambda s: F.array_sort(F.collect_set(F.when(F.col("source") == s, F.col("column"))))
    sets = claims.where("not conditional").groupBy("item_id", "scope", "role").agg(columns("task").alias("task_columns"), columns("rubric").alias("rubric_columns"))
    return sets.where("size(task_columns) > 0 and size(rubric_columns) > 0 and task_columns <> rubric_columns")


def rubric_contradictions(claims: DataFrame) -> DataFrame:
    """(item_id, kind, scope, subject, others): one_role_multiple_columns and one_column_multiple_roles among a rubric's unconditional
    claims of one known scope. Both from one pass, by grouping sets."""
    known = claims.where("source = 'rubric' and not conditional and scope <> 'unspecified'").select("item_id", "scope", "role", "column").distinct()
    sides = known.select("item_id", "scope", F.explode(F.array(F.struct(F.lit("one_role_multiple_columns").alias("kind"), F.col("role").alias("subject"), F.col("column").alias("other")), F.struct(F.lit("one_column_multiple_roles").alias("kind"), F.col("column").alias("subject"), F.col("role").alias("other")))).alias("s"))
    return sides.groupBy("item_id", "s.kind", "scope", "s.subject").agg(F.array_sort(F.collect_set("s.other")).alias("others")).where("size(others) > 1")
