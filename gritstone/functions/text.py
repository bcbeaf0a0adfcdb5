"""Text Columns: normalisers, hashes, tokens, shingles, parsers. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: String and character literals, and comments beside them (fixed patterns; possessive, since Java's matcher recurses on groups).
LITERAL = r"""\"[^\"\\]*+(?:\\[\s\S][^\"\\]*+)*+\"|'[^'\\]*+(?:\\[\s\S][^'\\]*+)*+'"""
COMMENT_OR_LITERAL = rf"({LITERAL})|//[^\r\n]*+|/\*(?s:.*?)\*/"
#: Spacing rules of the two literal-masking normalisers, in their order (fixed values); the short one has the first four.
SPACING = (
    (r"(\w)\s+\(", "$1("), (r"\(\s+", "("), (r"\s+\)", ")"), (r"(\w)\s+\[", "$1["),
    (r"\[\s+", "["), (r"\s+\]", "]"), (r"\s+;", ";"), (r"\s+,", ","), (r",(\S)", ", $1"),
    (r"\{\s*\}", "{}"), (r"(\S)\{", "$1 {"), (r"\{([^\s}])", "{ $1"), (r"([^\s{])\}", "$1 }"),
)
SHORT_RULES = 4
#: Tokens of the 26 code metrics (fixed pattern) and of near-clone shingles.
METRIC_TOKEN = r"0[xX][0-9a-fA-F]+|\d+(?:\.\d+)?|[A-Za-z_]\w*|->|::|<<|>>|<=|>=|==|!=|&&|\|\||\+\+|--|[^\s]"
#: Phrases that leak a label into a prompt (fixed patterns, any case).
LEAKS = (r"\bLabel\s*:", r"\bground[\s-]*truth\b", r"\bTARGET LABEL\b", r"\bthe target is (?:vulnerable|non-vulnerable)\b")


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip_comments(code) -> Column:
    """Comments become a space; literals stay. (A mark follows each match; those right after a literal go again.)"""
    marked = F.regexp_replace(_c(code), COMMENT_OR_LITERAL, "$1\x02")
    return F.replace(F.regexp_replace(marked, "([\"'])\x02", "$1"), F.lit("\x02"), F.lit(" "))


def token_stream(code) -> Column:
    """Comments and all white space out."""
    return F.regexp_replace(strip_comments(code), r"\s+", "")


def plain_normalized(code) -> Column:
    """Comments out even inside literals, then all white space out."""
    return F.regexp_replace(F.regexp_replace(_c(code), r"//[^\n]*|/\*[\s\S]*?\*/", ""), r"\s+", "")


def layout(code) -> Column:
    """CRLF to LF, runs of line feeds to one, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(_c(code), "\r\n", "\n"), "\n+", "\n"))


def collapse(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def sha(text, n: int = 64) -> Column:
    """First n hex digits of sha256."""
    return F.substring(F.sha2(_c(text), 256), 1, n)


def normalize_spacing(code, rules: int = len(SPACING)) -> Column:
    """Comments out, white space collapsed, and spacing around marks by the first ``rules`` rules, outside literals.

    Literals are cut out, one mark for each, and put back between the pieces that the marks part.
    """
    plain = F.replace(strip_comments(code), F.lit("\x01"), F.lit(" "))
    literals = F.regexp_extract_all(plain, F.lit(f"({LITERAL})"), 1)
    masked = F.trim(F.regexp_replace(F.regexp_replace(plain, LITERAL, "\x01"), r"\s+", " "))
    for pattern, to in SPACING[:rules]:
        masked = F.regexp_replace(masked, pattern, to)
    masked = F.trim(F.regexp_replace(masked, r"\s+", " "))
    return F.array_join(F.zip_with(F.split(masked, "\x01"), literals, lambda x, y: F.concat(x, F.coalesce(y, F.lit("")))), "")


def normalize_wide(code) -> Column:
    return normalize_spacing(code)


def normalize_short(code) -> Column:
    return normalize_spacing(code, SHORT_RULES)


def words(text) -> Column:
    """White-space words; none for NULL."""
    return F.coalesce(F.regexp_extract_all(_c(text), F.lit(r"([^ \t\n\r\f\x0B]+)"), 1), F.array().cast("array<string>"))


def tokens(text, pattern: str = METRIC_TOKEN) -> Column:
    return F.coalesce(F.regexp_extract_all(_c(text), F.lit(f"({pattern})"), 1), F.array().cast("array<string>"))


def shingles(toks, k: int, sep: str = " ") -> Column:
    """Distinct k-grams of an array of tokens; none if it has fewer."""
    empty = F.array().cast("array<string>")

    def of(t):
        grams = F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.array_join(F.slice(t, i, k), sep))
        return F.when(F.size(t) >= k, F.array_distinct(grams)).otherwise(empty)

    # Bound by a lambda, the tokens are made once and not for each gram.
    return F.element_at(F.transform(F.array(_c(toks)), of), 1)


def shingle_hashes(toks, k: int) -> Column:
    """Distinct 64-bit hashes of the k-grams of an array of tokens; none if it has fewer."""
    empty = F.array().cast("array<long>")

    def of(t):
        return F.when(F.size(t) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(t) - (k - 1)), lambda i: F.xxhash64(F.slice(t, i, k))))).otherwise(empty)

    return F.element_at(F.transform(F.array(_c(toks)), of), 1)


def jaccard(a, b) -> Column:
    """Of two arrays of distinct values; 0 if either is empty."""
    a, b = _c(a), _c(b)
    both = F.size(F.array_intersect(a, b)).cast("double")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / (F.size(a) + F.size(b) - both))


def jaccard_or_one(a, b) -> Column:
    """As jaccard, but 1 if both are empty."""
    a, b = _c(a), _c(b)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(jaccard(a, b))


# Words and groups of the 26 code metrics.
METRIC_WORDS = ("if", "else", "for", "while", "switch", "case", "return", "goto", "break", "sizeof")
METRIC_GROUPS = {
    "null": ("null", "nullptr"),
    "star": ("*",),
    "arrow": ("->",),
    "bracket": ("[",),
    "compare": ("<", ">", "<=", ">=", "==", "!="),
    "logic": ("&&", "||", "!"),
    "arith": ("+", "-", "*", "/", "%"),
    "alloc": ("malloc", "calloc", "realloc", "alloca", "new"),
    "free": ("free", "delete"),
    "copy": ("memcpy", "memmove", "strcpy", "strncpy"),
    "input": ("read", "recv", "scanf", "gets"),
    "error": ("errno", "error", "fail"),
    "assert": ("assert",),
}


def code_metrics(text, toks) -> dict[str, Column]:
    """The 26 numbers; toks: lower-cased tokens of METRIC_TOKEN."""
    text, toks = _c(text), _c(toks)
    n_lines = F.when(F.length(text) == 0, 0).otherwise(F.size(F.split(F.regexp_replace(text, r"\r?\n$", ""), r"\r\n|\n|\r")))

    def n(values):
        return F.size(F.filter(toks, lambda t: t.isin(*values))).cast("double")

    out = {"log_bytes": F.log1p(F.octet_length(text).cast("double")), "log_lines": F.log1p(n_lines.cast("double")), "log_tokens": F.log1p(F.size(toks).cast("double"))}
    return out | {f"n_{w}": n((w,)) for w in METRIC_WORDS} | {f"n_{k}": n(v) for k, v in METRIC_GROUPS.items()}


def leaks(prompt) -> Column:
    low = F.lower(_c(prompt))
    held = low.contains("label") | low.contains("truth") | low.contains("the target is ")  # what every match holds, looked for first
    return held & low.rlike("|".join(x.lower() for x in LEAKS))


def strict_binary(raw, finish) -> Column:
    """0 or 1 if that is all the answer says and it wasn't cut off."""
    answer = F.trim(_c(raw))
    return F.when(F.coalesce(_c(finish) == "length", F.lit(False)), F.lit(None).cast("int")).when(answer.isin("0", "1"), answer.cast("int"))


# Phrases of the free-text parser, in lower case.
HEDGES = (
    r"cannot determine",
    r"can't determine",
    r"not sure",
    r"unable to determine",
    r"both 0 and 1",
    r"both vulnerable and safe",
    r"both safe and vulnerable",
    r"vulnerable\s*\(\s*1\s*\).*safe\s*\(\s*0\s*\)",
    r"safe\s*\(\s*0\s*\).*vulnerable\s*\(\s*1\s*\)",
)
SAID_SAFE = (
    r"\bnon-vulnerable\s*\(\s*0\s*\)",
    r"\b(label|output|answer):\s*non-vulnerable",
    r"\b(label|output|answer|prediction):\s*0\b",
)
SAID_VULNERABLE = (
    r"\bvulnerable\s*\(\s*1\s*\)",
    r"\b(label|output|answer):\s*vulnerable",
    r"\b(label|output|answer|prediction):\s*1\b",
)
SAFE_WORDS = (
    r"\bnon-vulnerable\b",
    r"\bnot\s+vulnerable\b",
    r"\bnot\s+a\s+vulnerability\b",
    r"\bno\s+(?:security\s+)?vulnerability\b",
    r"\b(function|code)\s+is\s+safe\b",
    r"\bsafe\b",
)
VULNERABLE_WORDS = (
    r"(?<!non-)(?<!not\s)(?<!no\s)\bvulnerable\b",
    r"(?<!no\s)(?<!not\s)vulnerabilit(?:y|ies)\b",
    r"\bsecurity\s+flaw\b",
)


def free_text_label(raw) -> Column:
    """struct(label, method) by ordered rules; contradictions and hedging have no label, and nothing defaults to 0.

    The rules, in order: a lone digit; a last line that is a lone digit; hedging; explicit labels; words that say so; a
    single kind of stand-alone digit.
    """
    text = F.trim(_c(raw))
    low = F.lower(text)
    last = F.lower(F.trim(F.element_at(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != ""), -1)))
    one, zero = ("1", "'1'", '"1"', "1."), ("0", "'0'", '"0"', "0.")
    hedge, said_safe, said_vuln, safe, vuln = (low.rlike("|".join(p)) for p in (HEDGES, SAID_SAFE, SAID_VULNERABLE, SAFE_WORDS, VULNERABLE_WORDS))
    has1, has0 = text.rlike(r"\b1\b"), text.rlike(r"\b0\b")

    def out(label, method):
        return F.struct(F.lit(label).cast("int").alias("label"), F.lit(method).alias("method"))

    return (
        F.when(text.isNull() | (text == ""), out(None, "empty"))
        .when(text.isin(*one), out(1, "strict"))
        .when(text.isin(*zero), out(0, "strict"))
        .when(last.isin(*one), out(1, "last_line"))
        .when(last.isin(*zero), out(0, "last_line"))
        .when(hedge, out(None, "hedging"))
        .when(said_vuln & said_safe, out(None, "contradiction"))
        .when(said_vuln, out(1, "explicit"))
        .when(said_safe, out(0, "explicit"))
        .when(vuln & safe, out(None, "contradiction"))
        .when(vuln, out(1, "semantic"))
        .when(safe, out(0, "semantic"))
        .when(has1 & ~has0, out(1, "digit"))
        .when(has0 & ~has1, out(0, "digit"))
        .otherwise(out(None, "unparseable"))
    )


def first_token_score(top) -> Column:
    """struct(s, p0, p1, pred, valid) from a map of token to log-probability: aliases of 0 and 1 keep their maximum."""
    top = _c(top)

    def best(digit: str):
        kept = F.map_filter(top, lambda k, _: F.regexp_replace(F.trim(k), "[\"'`.]", "") == digit)
        return F.coalesce(F.exp(F.array_max(F.map_values(kept))), F.lit(0.0))

    p0, p1 = best("0"), best("1")
    ok = (p0 + p1) > 0
    return F.struct(
        F.try_divide(p1, p0 + p1).alias("s"), p0.alias("p0"), p1.alias("p1"), F.when(ok, F.when(p1 >= p0, 1).otherwise(0)).alias("pred"), F.coalesce(ok, F.lit(False)).alias("valid")
    )


def approx_tokens(text) -> Column:
    """ceil(len / 4) written as floor(len / 4 + 0.999)."""
    return F.floor(F.length(_c(text)) / F.lit(4.0) + 0.999).cast("long")


def fit_tokens(text, budget: int, marker: str = "\n...[truncated]") -> Column:
    """The text if it fits, else its longest prefix that does together with the marker."""
    text = _c(text)
    room = budget * 4 - len(marker)
    return F.when(approx_tokens(text) <= budget, text).otherwise(F.concat(F.substring(text, 1, max(room, 0)), F.lit(marker)))


def camel_words(name) -> Column:
    """camelCase and snake_case to lower-case words."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(name), "([a-z0-9])([A-Z])", "$1 $2"), "([A-Z]+)([A-Z][a-z])", "$1 $2"), "[_ ]+", " ")))


def flip_label_words(text) -> Column:
    """Swaps Vulnerable and Non-vulnerable, safe and unsafe, through marks that no text has."""
    out = _c(text)
    for a, b in (("Non-vulnerable", "\x01"), ("Vulnerable", "\x02"), ("\\bunsafe\\b", "\x03"), ("\\bsafe\\b", "\x04")):
        out = F.regexp_replace(out, a, b)
    for a, b in (("\x01", "Vulnerable"), ("\x02", "Non-vulnerable"), ("\x03", "safe"), ("\x04", "unsafe")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_id(raw) -> Column:
    """`id_<n>_...` to n, `a:b:c#k` to c, else white space collapsed."""
    raw = _c(raw)
    by_number = F.regexp_extract(raw, r"^id_(\d+)_", 1)
    by_hash = F.regexp_extract(raw, r"^[^:]*:[^:]*:([^#]+)", 1)
    return F.when(by_number != "", by_number).when(by_hash != "", by_hash).otherwise(collapse(raw))


def truthy_label(raw) -> Column:
    """1 for 1, true, vuln or vulnerable in any case, else 0."""
    return F.when(F.lower(F.trim(_c(raw).cast("string"))).isin("1", "true", "vuln", "vulnerable"), 1).otherwise(0)


def identity_uid(dataset, split, path, code) -> Column:
    """dataset:split:sha256 of canonical JSON of the identity fields; the label isn't part of it."""
    canonical = F.to_json(F.struct(F.sha2(layout(code), 256).alias("code_sha256"), _c(dataset).alias("dataset"), F.lit(1).alias("schema"), _c(path).alias("source_path"), _c(split).alias("split")))
    return F.concat_ws(":", _c(dataset), _c(split), F.sha2(canonical, 256))


def reviewer_choice(raw, method_of_a, method_of_b) -> Column:
    """A or B to the method assigned to it; equal, neither and unrated by their synonyms."""
    low = F.lower(F.trim(_c(raw)))
    return (
        F.when(low.isNull() | low.isin("", "unrated", "n/a", "none", "?"), "Unrated")
        .when(low.isin("equal", "tie", "both", "same"), "Equal")
        .when(low.isin("neither", "none of them"), "Neither")
        .when(low.rlike(r"^(demo(nstration)?|option|choice)?\s*a\b"), _c(method_of_a))
        .when(low.rlike(r"^(demo(nstration)?|option|choice)?\s*b\b"), _c(method_of_b))
        .otherwise("Unrated")
    )
