"""C functions made of the words of documents, in Spark and in DuckDB SQL, and what each of their statements holds.

Every three words of a document are one statement: a hash of the words picks the statement, the words name its variables.
So whole texts are scanned, copies give equal code, and SQL knows the calls, states and roles by statement.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import functions as F

from ._bind import WORDS, read, small_batches, spread

#: Statement, and its calls as (name, status, state, role); %a, %b and %c stand for the words.
STATEMENTS = (
    ("  if (%a < %b) memcpy(%a, %c, %b);", [("memcpy", "recognized", "active", "not_assessed")]),
    ("  free(%a);", [("free", "recognized", "active", "not_assessed")]),
    ("  %a->next = %b[%c];", []),
    ("  helper_%a(%b, %c);", [("helper_%a", "unknown", "active", "not_assessed")]),
    ('  printf("%s", %a);', [("printf", "recognized", "active", "standard_stdout")]),
    ('  fprintf(stderr, "free(%a)");', [("fprintf", "recognized", "active", "diagnostic_stderr")]),
    ("#ifdef HAVE_%a\n  g_free(%b);\n#endif", [("g_free", "recognized", "conditional", "not_assessed")]),
    ("#if 0\n  strcpy(%a, %b);\n#else\n  av_freep(%c);\n#endif", [("strcpy", "excluded_inactive", "inactive", "not_assessed"), ("av_freep", "recognized", "active", "not_assessed")]),
    ("  if (!%a) return -1;", []),
    ("  // memcpy(%a, %b, %c);", []),
    ("  /* free(%a); */ %b = %c + 1;", []),
    ('  %a = "strcpy(%b)";', []),
    ("  assert(%a);", [("assert", "unknown", "active", "not_assessed")]),
    ("  %a.free(%b); %a->read(%c);", [("free", "unknown", "active", "not_assessed"), ("read", "unknown", "active", "not_assessed")]),
    ("  WRAP(%a); sprintf(%b, %c);", [("WRAP", "unknown", "active", "not_assessed"), ("sprintf", "recognized", "active", "buffer_formatting")]),
    ("  if (%a == NULL) goto out;", []),
    ("#if LIMIT > 4\n  g_strdup(malloc(%a));\n#endif", [("g_strdup", "recognized", "conditional", "not_assessed"), ("malloc", "recognized", "conditional", "not_assessed")]),
)
#: Conditions and their values.
CONDITIONS = (
    ("0 && %a", False), ("1 || %a", True), ("defined(%a)", None), ("1 + 1", None), ("!0x0", True), ("!(%a && 1)", None),
    ("%a && 0 || 1", True), ("(0 || 0) && defined %a", False), ("08", None), ("!(1 && 0x10u)", False), ("0 &&", None),
)


def _groups(spark, d, of):
    """id and groups: of(a, b, c, hash) for every three words of a document; a missing word is empty.

    Words are made names and cut into threes by patterns over the whole text, so that one lambda over short strings is
    left: an index into the list of names would make the list again for each group.
    """
    blank = r" \t\n\r\f\x0B"
    named = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), f"([^{blank}]+)", "v_$1")), f"[^a-z0-9_{blank}]", "")
    threes = F.regexp_extract_all(named, F.lit(f"([^{blank}]+(?:[{blank}]+[^{blank}]+){{0,2}})"), 1)

    def one(three):
        a, b, c = (F.coalesce(F.get(F.split(three, f"[{blank}]+"), F.lit(k)), F.lit("v_")) for k in range(3))
        return of(a, b, c, F.conv(F.substring(F.md5(F.concat_ws(",", a, b, c)), 1, 7), 16, 10).cast("int"))

    return spread(read(spark, d, "documents").select("doc_id", "text")).select(F.col("doc_id").alias("id"), F.transform(threes, one).alias("groups"))


def _filled(texts, a, b, c, h):
    text = F.element_at(F.array(*[F.lit(t) for t in texts]), F.pmod(h, F.lit(len(texts))) + 1)
    for mark, value in (("%a", a), ("%b", b), ("%c", c)):
        text = F.replace(text, F.lit(mark), value)
    return text


_BLANK = r" \t\n\r\f\x0B"
_FORMS = tuple(re.sub(r"%([abc])", lambda m: "{" + str("abc".index(m[1])) + "}", s.replace("{", "{{").replace("}", "}}")).format for s, _ in STATEMENTS)


def code_of(text: str | None) -> str:
    """The function made of a text's words, named by the first."""
    words = re.findall(f"[^{_BLANK}]+", (text or "").lower())
    names = re.sub("[^a-z0-9_ ]+", "", "v_" + " v_".join(words)).split(" ") if words else []
    body = []
    for k in range(0, len(names), 3):
        three = (names[k : k + 3] + ["v_", "v_"])[:3]
        body.append(_FORMS[(int.from_bytes(hashlib.md5(",".join(three).encode()).digest()[:4], "big") >> 4) % len(_FORMS)](*three))
    return f"int helper_{names[0] if names else 'v_'}(char *buf, int len) {{\n" + "\n".join(body) + "\n}\n"


def _coded(batches):
    for batch in batches:
        for k in range(0, len(batch), 200):
            part = batch.slice(k, 200)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([code_of(x) for x in part.column(1).to_pylist()], pa.string())], ["id", "code"])


def texts(spark, d):
    """id, text of every document, for functions that make its code."""
    small_batches(spark)
    return spread(read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))


def codes(spark, d):
    """id, code of every document: a function named by the first word, so that calls find definitions."""
    rows = texts(spark, d)
    return rows.mapInArrow(_coded, f"id {dict(rows.dtypes)['id']}, code string")


def _shown(text: str, most: int) -> str:
    """The text without blanks at its ends, and of a longer one ``most`` characters and a mark that it is longer."""
    text = text.strip(" ")
    return text[:most] + "." if len(text) > most else text


def heads(spark, d, code: int, func: int, lines: int):
    """id, code, func, lines and n_lines of every document: what layouts with caps show of its code, and how many lines it has."""

    def made(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                whole = code_of(text)
                full = [x for x in whole.split("\n") if x.strip(" ")]
                out.append((_shown(whole, code), _shown(whole, func), full[:lines], len(full)))
            columns = list(zip(*out)) or [[]] * 4
            kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], ["id", "code", "func", "lines", "n_lines"])

    rows = texts(spark, d)
    return rows.mapInArrow(made, f"id {dict(rows.dtypes)['id']}, code string, func string, lines array<string>, n_lines int")


def conditions(spark, d):
    """id, k, text: a preprocessor condition for every three words."""
    rows = _groups(spark, d, lambda a, b, c, h: _filled([s for s, _ in CONDITIONS], a, b, c, h))
    return rows.select("id", F.posexplode("groups").alias("k", "text"))


_W = f"list_transform({WORDS}, lambda w: 'v_' || regexp_replace(lower(w), '[^a-z0-9_]', '', 'g'))"
#: CTE `st`: id, a, b, c and h of every three words.
GROUPS = f"""ws AS (SELECT doc_id AS id, {_W} AS ws FROM documents),
gs AS (SELECT id, unnest(range(0, len(ws), 3)) AS i, ws FROM ws),
ab AS (SELECT id, i, ws[i + 1] AS a, COALESCE(ws[i + 2], 'v_') AS b, COALESCE(ws[i + 3], 'v_') AS c FROM gs),
st AS (SELECT *, ('0x' || substr(md5(a || ',' || b || ',' || c), 1, 7))::BIGINT AS h FROM ab)"""


def _literal(x) -> str:
    return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else "'" + x + "'"


#: CTEs up to `calls`: id, api, status, state, role of every call site.
_FACTS = ", ".join(f"({k}, {', '.join(map(_literal, call))})" for k, (_, calls) in enumerate(STATEMENTS) for call in calls)
CALLS = f"{GROUPS}, facts(k, api, status, state, role) AS (VALUES {_FACTS}), calls AS (SELECT id, replace(api, '%a', a) AS api, status, state, role FROM st JOIN facts ON h % {len(STATEMENTS)} = k)"
_VALUES = ", ".join(f"({k}, {_literal(v)})" for k, (_, v) in enumerate(CONDITIONS))
#: CTEs up to `judged`: id and value of every condition.
JUDGED = f"{GROUPS}, facts(k, value) AS (VALUES {_VALUES}), judged AS (SELECT id, value FROM st JOIN facts ON h % {len(CONDITIONS)} = k)"
