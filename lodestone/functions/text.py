"""Scalar text functions as columns."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = r"""[!"#$%&'()*+,/:;<=>?@\[\\\]^_`{|}~]|\.(?!\d)|(?<!\d)\.|-(?!\d)|(?<=\p{L})-"""


def blank(x: Column) -> Column:
    return F.trim(F.coalesce(x, F.lit(""))) == ""


def normalize_text(x: Column) -> Column:
    """Trimmed, lower case, white space as single blanks."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " ")))


def normalize_loose(x: Column) -> Column:
    """As normalize_text, without articles and without punctuation that carries no value."""
    x = F.regexp_replace(normalize_text(x), PUNCTUATION, "")
    x = F.regexp_replace(x, r"\b(the|a|an)\b", " ")
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def normalize_choice(x: Column) -> Column:
    """For comparing choices: dashes alike, no leading label."""
    x = F.translate(normalize_text(x), "–—−", "---")
    return F.trim(F.regexp_replace(x, r"^[a-z]\s*[.):]\s*", ""))


def parse_number(x: Column) -> Column:
    """The first signed decimal number, commas dropped; null if there is none."""
    return F.regexp_extract(F.regexp_replace(x, ",", ""), r"([-+]?\d+(?:\.\d+)?)", 1).try_cast("double")


def parse_ratio(x: Column) -> Column:
    """a/b or a:b as a quotient, else the first number."""
    a, b = (F.regexp_extract(x, r"^\s*([-+]?\d+(?:\.\d+)?)\s*[/:]\s*([-+]?\d+(?:\.\d+)?)\s*$", i).try_cast("double") for i in (1, 2))
    return F.coalesce(F.try_divide(a, b), parse_number(x))


def invisible_count(x: Column) -> Column:
    """Characters of category Cf or Cc other than tab, line feed and carriage return."""
    return F.regexp_count(F.coalesce(x, F.lit("")), F.lit(r"[\p{Cf}\p{Cc}&&[^\t\n\r]]"))


def split_list(x: Column) -> Column:
    """Parts of a list answer: comma, semicolon, bar or the word and."""
    return F.filter(F.split(x, r"\s*(?:,|;|\||\band\b)\s*"), lambda p: F.trim(p) != "")


def pieces(x: Column, pattern: str, group: int = 0) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(pattern), group))


def search_terms(x: Column, stopwords: tuple[str, ...] = ("the", "and", "for", "with", "that", "this", "from")) -> Column:
    """Numbers, quoted strings, file names and longer words, without stop words."""
    found = F.concat(pieces(x, r"\d+(?:\.\d+)?"), pieces(x, r'"([^"]+)"', 1), pieces(x, r"[\w-]+\.[A-Za-z]{2,5}\b"), pieces(F.lower(x), r"[a-z]{4,}"))
    return F.filter(F.array_distinct(found), lambda t: ~t.isin(*stopwords))


# What a rubric's numbers name without asserting them, in the order in which it is taken out; equal results need equal patterns.
_AMOUNT = r"\d[\d,]*\.?\d*"
NOT_ASSERTED = (
    r"(?iU)\b[\w\-./]+\.(?:xlsx|xls|csv|txt|docx?|pdf|md|py|json|pptx?|png|html?)\b",
    r"(?i)(?:≥|≤|>=|<=|>|<|至少|至多|不少于|不超过|不低于|不高于|大于|小于|超过|低于|高于|at least|at most|no (?:less|more) than|not (?:less|more) than|"
    rf"greater than|less than|more than|over|above|below|up to|within|between)\s*[¥$]?\s*{_AMOUNT}\s*%?",
    rf"(?U)\b{_AMOUNT}\s*%?\s*(?:-|to|~|–|—|至|到)\s*{_AMOUNT}\s*%",
    rf"(?U)\b{_AMOUNT}\s*(?:-|–|—|~|至|到)\s*{_AMOUNT}\b",
    r"(?U)\b[A-Za-z]{1,}[-_]?\d[\w-]*",
    r"#\s*\d+",
    r"(?iU)\b(?:item|items|partner|chapter|page|pages|top|no|number|question|article|figure|fig|table|slide|part|day|days|month|months|week|weeks|step|point|"
    r"grades?|level|priority|section|row|column|col|q|dev|proj)\.?\s*#?\s*\d+",
    r"第\s*\d+\s*(?:个|条|项|章|页|位|名|列|行|款|季度|周|天|月)?",
    r"序号\s*\d+",
    r"(?:19|20)\d{2}\s*年",
    r"\d{1,2}\s*[月日号]",
    r"(?U)\b(?:19|20)\d{2}\b",
)


def numbers(x: Column) -> Column:
    """All unsigned decimal numbers, in order and with repeats, commas dropped."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(x, ",", ""), F.lit(r"\d[\d,]*\.?\d*"), 0), lambda n: n.try_cast("double"))


def rubric_numbers(x: Column) -> Column:
    """The numbers that a rubric asserts: file names, thresholds, ranges, identifiers, ordinals and dates don't count."""
    x = F.coalesce(x, F.lit(""))
    for pattern in NOT_ASSERTED:
        x = F.regexp_replace(x, pattern, " ")
    return numbers(x)


def missed(expected: Column, output: Column) -> Column:
    """Those of the expected numbers that no `label=value` line of an output has to within 0.5 % or 1."""
    values = F.transform(F.filter(F.split(F.coalesce(output, F.lit("")), r"\r?\n"), lambda s: F.contains(s, F.lit("="))), lambda s: F.substring_index(s, "=", -1))
    got = F.flatten(F.transform(values, numbers))
    return F.filter(expected, lambda e: ~F.exists(got, lambda g: F.abs(g - e) <= F.greatest(F.lit(1.0), 0.005 * F.abs(e))))


def path_like(x: Column) -> Column:
    return x.rlike(r"^[\w./\\-]+\.[A-Za-z0-9]{1,5}$")


# Code lines too common to tell a solution; equal results need equal ones.
GENERIC_LINES = ("pass", "continue", "break", "return", "return none", "return true", "return false", "return 0", "return 1", "none", "true", "false", "else:", "try:", "finally:")


def substantive(line: Column) -> Column:
    """Whether an added line is concrete code: not short, generic, a comment, a bare string, a constant or a keyword alone,
    and with code punctuation, or with words enough of which one has an underscore or the first joins conditions."""
    flat = F.trim(F.regexp_replace(F.lower(line), r"\s+", " "))
    noise = line.rlike(r"""^(?:#|//|\*)|^[rubfRUBF]*(?:'{3}|"{3}|['"]{3})|^[rubfRUBF]*['"][^'"]{0,40}['"]$""")
    bare = flat.rlike(r"^(?:(?:return\s+)?(?:none|true|false|\d+(?:\.\d+)?)|(?:raise|except|elif|if|for|while|with|class|def)\b[:\s]*)$")
    words = F.regexp_extract_all(line, F.lit(r"[A-Za-z_][A-Za-z0-9_]*"), 0)
    named = (F.size(words) >= 2) & F.exists(words, lambda w: F.contains(w, F.lit("_")))
    joined = (F.size(words) >= 3) & F.lower(F.get(words, F.lit(0))).isin("and", "or", "not", "is", "in")
    return (F.length(line) >= 8) & ~flat.isin(*GENERIC_LINES) & ~noise & ~bare & (line.rlike(r"[=().:\[\]{},]") | named | joined)


def let(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is worked out once however often it is used."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


_ATOM = r"n?(?:\d+\.?\d*|\.\d+)(?:E-?\d+)?"  # n marks a negative value that a bracket was replaced by
_FACTOR = rf"[+-]*{_ATOM}(?:\*\*[+-]*{_ATOM})*"
_TERM = rf"{_FACTOR}(?:(?:\*|//|/){_FACTOR})*"


def _operate(a: Column, op: Column, b: Column) -> Column:
    """a op b, each of them worked out once."""
    return let(F.struct(a.alias("a"), op.alias("op"), b.alias("b")), lambda x: _operated(x["a"], x["op"], x["b"]))


def _operated(a: Column, op: Column, b: Column) -> Column:
    """a op b for + - * / // **; null where it has no finite value."""
    power = F.pow(a, b)
    power = F.when(~F.isnan(power) & (F.abs(power) < float("inf")), power)
    return F.when(op == "+", a + b).when(op == "-", a - b).when(op == "*", a * b).when(op == "/", F.try_divide(a, b)).when(op == "//", F.floor(F.try_divide(a, b)).cast("double")).when(op == "**", power)


def _atom(x: Column) -> Column:
    """The value of an atom with the signs before it."""
    bare = F.regexp_replace(x, "^[+-]*", "")
    size = F.when(F.startswith(bare, F.lit("n")), -F.substr(bare, F.lit(2)).try_cast("double")).otherwise(bare.try_cast("double"))
    return size * _sign(x)


def _sign(x: Column) -> Column:
    return F.when(F.length(F.replace(F.regexp_extract(x, "^[+-]*", 0), F.lit("+"), F.lit(""))) % 2 == 1, -1.0).otherwise(1.0)


def _flat(x: Column) -> Column:
    """The value of an expression without brackets and blanks."""
    op = r"^(?:\*|//|/)"

    def factor(f: Column) -> Column:  # powers go from the right, and bind closer than the sign on their left
        parts = F.split(f, r"\*\*")
        last = F.element_at(parts, -1)
        before = F.reverse(F.slice(parts, F.lit(1), F.size(parts) - 1))
        return F.aggregate(before, _atom(last), lambda value, p: _sign(p) * _operate(_atom(F.regexp_replace(p, "^[+-]*", "")), F.lit("**"), value))

    def product(t: Column) -> Column:
        each = F.regexp_extract_all(t, F.lit(rf"(?:\*|//|/)?{_FACTOR}"), F.lit(0))
        return let(each, lambda fs: F.aggregate(F.slice(fs, F.lit(2), F.size(fs)), factor(F.get(fs, F.lit(0))), lambda value, f: _operate(value, F.regexp_extract(f, op, 0), factor(F.regexp_replace(f, op, "")))))

    def total(ts: Column) -> Column:
        return F.aggregate(F.slice(ts, F.lit(2), F.size(ts)), product(F.get(ts, F.lit(0))), lambda value, t: _operate(value, F.substr(t, F.lit(1), F.lit(1)), product(F.substr(t, F.lit(2)))))

    return F.when(x.rlike(rf"^{_TERM}(?:[+-]{_TERM})*$"), let(F.regexp_extract_all(x, F.lit(_TERM), F.lit(0)), total))


def expression_value(x: Column) -> Column:
    """The value of an expression of decimal numbers, + - * / // ** and brackets, with the usual signs and precedence, powers from the
    right; null for what isn't one, for division by zero and for results that aren't finite. A whole number with leading
    zeros isn't one (zero itself is), so that a date isn't taken for a difference; nor is text over several lines.

    Two numbers with one sign between them, as most are, are worked out in compiled code; other expressions by brackets,
    from the inside, each replaced by its value.
    """
    number = r"\d+\.?\d*|\.\d+"
    pair = rf"^([-+]?(?:{number}))\s*(\+|-|\*\*|\*|//|/)\s*({number})$"
    part = lambda i: F.regexp_extract(x, pair, i)
    # two values side by side, a sign cut in two, a number that starts with zeros, a line's end
    barred = x.rlike(r"[\d.]\s+[\d.]|[\d.)]\s*\(|\)\s*[\d.]|\*\s+\*|/\s+/|(?<![\d.])0+[1-9]\d*(?![\d.])|[\r\n]")
    simple = x.rlike(pair) & ~x.rlike(r"^-.*\*\*")

    def inner(s: Column, _: Column) -> Column:
        written = lambda v: F.concat(F.when(v < 0, "n").otherwise(""), F.abs(v).cast("string"))
        return let(F.regexp_extract(s, r"\(([^()]*)\)", 1), lambda m: let(_flat(m), lambda v: F.when(v.isNull() | ~(F.abs(v) < float("inf")), s).otherwise(F.replace(s, F.concat(F.lit("("), m, F.lit(")")), written(v)))))

    steps = F.sequence(F.lit(0), F.regexp_count(x, F.lit(r"\(")))  # one more than there are brackets, which changes nothing
    general = let(F.aggregate(steps, F.regexp_replace(x, r"\s+", ""), inner), _flat)
    return F.when(~barred, F.when(simple, _operated(part(1).try_cast("double"), part(2), part(3).try_cast("double"))).otherwise(general))


def added_lines(patch: Column) -> Column:
    """Substantive added lines of a unified diff, each once, in order."""
    lines = F.filter(F.split(F.coalesce(patch, F.lit("")), r"\r?\n"), lambda s: s.rlike(r"^\+(?!\+\+)"))
    bare = F.transform(lines, lambda s: F.trim(F.regexp_replace(F.substr(s, F.lit(2)), r"^\s+|\s+$", "")))
    return F.array_distinct(F.filter(bare, substantive))


def nfkc_casefold(x: Column) -> Column:
    """NFKC and case folding, which have no built-in."""
    import pyarrow as pa

    def run(v):
        return pa.array([None if t is None else unicodedata.normalize("NFKC", t).casefold() for t in v.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(x)


def folded(x: Column) -> Column:
    """nfkc_casefold for what isn't plain ASCII."""
    return F.when(x.rlike(r"^[\x00-\x7F]*$"), F.lower(x)).otherwise(nfkc_casefold(x))
