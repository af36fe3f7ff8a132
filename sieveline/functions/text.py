"""Text functions: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Forms of secrets, tried in this order, ignoring case.
SECRETS = (
    r"(?:AKIA|ASIA|AGPA|AIDA|AROA)[A-Z0-9]{16}",
    r"sk-ant-api03-[A-Za-z0-9\-_]{80,}",
    r"sk-ant-[A-Za-z0-9\-_]{20,}",
    r"sk-proj-[A-Za-z0-9\-_]{40,}",
    r"sk-svcacct-[A-Za-z0-9\-_]{40,}",
    r"sk_proj_[A-Za-z0-9\-_]{40,}",
    r"sk_svcacct_[A-Za-z0-9\-_]{40,}",
    r"sk-[A-Za-z0-9]{32,}",
    r"github_pat_[A-Za-z0-9_]{36,}",
    r"gh[pousr]_[A-Za-z0-9_]{36,}",
    r"glpat-[A-Za-z0-9\-_]{20,}",
    r"(?:sk_live|rk_live|pk_live)_[A-Za-z0-9]{24,}",
    r"xox[baprs]-[A-Za-z0-9\-]{10,}",
    r"https://hooks\.slack\.com/services/T[A-Z0-9]{8,}/B[A-Z0-9]{8,}/[A-Za-z0-9]{24,}",
    r"SG\.[A-Za-z0-9\-_]{22,}\.[A-Za-z0-9\-_]{43,}",
    r"twilio[^=]*=\s*[a-f0-9]{32}\b",
    r"npm_[A-Za-z0-9]{36,}",
    r"pypi-[A-Za-z0-9_\-]{20,}",
    r"dckr_pat_[A-Za-z0-9\-_]{20,}",
    r"https://[a-f0-9]+@sentry\.io/[0-9]+",
    r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_]+",
    r"-----BEGIN\s+(?:[A-Z0-9]+\s+)?PRIVATE\s+KEY-----",
    r"""(?<=://)[^\s:@/"']*:[^\s@/"']+(?=@)""",
    r"""(?:apikey|api_key|secret_key|auth_token|authToken|TWILIO_AUTH_TOKEN)\s*[=:]\s*["'][A-Za-z0-9\-_]{32,}["']""",
)
_SECRET = "(?i)" + "|".join(f"(?:{p})" for p in SECRETS)
_MARK = "\ue000"
#: Signs in lower case, of which one is in every secret of the forms (by place in SECRETS) beside them.
_SIGNS = (
    (("akia", "asia", "agpa", "aida", "aroa"), (0,)), (("sk-",), (1, 2, 3, 4, 7)), (("sk_", "rk_live", "pk_live"), (5, 6, 11)), (("github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-"), (8, 9, 10)),
    (("xox",), (12,)), (("://",), (13, 19, 22)), (("sg.",), (14,)), (("twilio",), (15,)), (("npm_", "pypi-", "dckr_pat_"), (16, 17, 18)), (("eyj",), (20,)), (("private",), (21,)), (("apikey", "api_key", "secret_key", "auth_token", "authtoken"), (23,)),
)


def redact(text: Column, max_chars: int | None = None) -> tuple[Column, Column]:
    """Text without secrets, and how many there were. `max_chars`: longer texts are left as they are. A text
    without signs goes through no pattern, one with signs of one group through that group's, others
    through all of them; forms whose signs a text lacks can't match in it, so the result is the same. Both
    columns are fields of one expression without a condition around it, so that it is evaluated once for both."""
    several = len(_SIGNS) + 1

    def group(t: Column) -> Column:
        """0 for a text without signs, the place of the only group with one, or a number beyond all groups."""
        present = F.transform(F.array(F.lower(t)), lambda low: F.array(*[reduce(lambda a, b: a | b, (low.contains(x) for x in signs)) for signs, _ in _SIGNS]))[0]
        found = F.transform(F.array(present), lambda flags: F.when(F.size(F.filter(flags, lambda x: x)) > 1, F.lit(several)).otherwise(F.array_position(flags, True).cast("int")))[0]
        return found if max_chars is None else F.when(F.length(t) > max_chars, 0).otherwise(found)

    def clean(row: Column) -> Column:
        t, own = row["t"], row["group"]

        def marked(pattern: str) -> Column:
            # one pass: a private character stands for each secret, is counted, and becomes the marker
            return F.transform(F.array(F.regexp_replace(t, pattern, _MARK)), lambda x: F.struct(F.replace(x, F.lit(_MARK), F.lit("[REDACTED]")).alias("o"), (F.length(x) - F.length(F.replace(x, F.lit(_MARK), F.lit("")))).alias("n")))[0]

        twice = F.struct(F.regexp_replace(t, _SECRET, "[REDACTED]").alias("o"), F.regexp_count(t, F.lit(_SECRET)).alias("n"))
        out = F.when(t.isNull(), F.lit(None)).when(own == 0, F.struct(t.alias("o"), F.lit(0).alias("n"))).when(t.contains(_MARK), twice)
        for k, (_, forms) in enumerate(_SIGNS, 1):
            out = out.when(own == k, marked("(?i)" + "|".join(f"(?:{SECRETS[f]})" for f in forms)))
        return out.otherwise(marked(_SECRET))

    bound = F.transform(F.array(text), lambda t: F.struct(t.alias("t"), group(t).alias("group")))
    both = F.transform(bound, clean)[0]
    return both["o"], both["n"]


def _replace_all(text: Column, *steps: tuple[str, str]) -> Column:
    return reduce(lambda c, s: F.regexp_replace(c, s[0], s[1]), steps, text)


#: Forms of titles (possessive, so that long ones don't exhaust the stack), control sequences, other escapes.
ESCAPES = (r"\x1b\][^\x07]*+\x07|\x1b\](?s:.)*?\x1b\\", r"\x1b\[[0-?]*[ -/]*[@-~]", r"\x1b\([B0UK]|\x1b[>#=]|\x1b\\\\", r"\x9b[0-9;]*[A-Za-z]")


def strip_ansi(text: Column) -> Column:
    """The text without escapes; one without their first characters needs no pattern."""
    return F.when(text.contains("\x1b") | text.contains("\x9b"), _replace_all(text, *((e, "") for e in ESCAPES))).otherwise(text)


#: Names of tags around a model's inner reasoning.
REASONING_TAGS = ("thinking", "antThinking", "reasoning", "scratchpad", "inner_monologue")
_NAME = r"(?:[a-zA-Z][a-zA-Z0-9_-]*:)?(?:" + "|".join(REASONING_TAGS) + ")"
_NESTING = 10


def strip_thinking(text: Column) -> Column:
    """Innermost closed blocks first, as often as blocks may nest; then what is left open or cut off. Texts
    without a sign of a tag go through no tag's pattern, and texts without long gaps through none for gaps."""
    inner = rf"(?is)<{_NAME}>(?:(?!<{_NAME}>).)*?</{_NAME}>"
    out = text
    for _ in range(_NESTING):
        out = F.regexp_replace(out, inner, "")
    out = _replace_all(out, (rf"(?is)<{_NAME}>.*", ""), (rf"(?is)</{_NAME}(?:\s[^<>]*)?(?=>|\z)", ""))
    out = F.when(text.contains("<") & text.rlike(rf"(?i)</?{_NAME}"), out).otherwise(text)

    def trimmed(x: Column) -> Column:
        thin = F.when(x.contains("\n\n\n"), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x)
        bare = F.regexp_replace(thin, r"(?U)\A\s+|\s+\z", "")
        return F.when(x.rlike(r"(?U)\A\s|\s\z"), F.when(bare == "", thin).otherwise(bare)).otherwise(thin)

    return F.transform(F.array(out), trimmed)[0]


#: Times, process ids, durations and sizes, in the order in which they are replaced.
_ISO = r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?"
NOISE = (
    (rf"(?U)\[{_ISO}\]", "[TIMESTAMP]"),
    (r"(?U)\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2}\s+[+-]\d{4}", "[TIMESTAMP]"),
    (rf"(?U){_ISO}", "[TIMESTAMP]"),
    (r"(?iU)\bPID\s*[:=]?\s*\d{1,7}\b", "[PID]"),
    (r"(?U)\b\d+(?:\.\d+)?\s*ms\b", "[X]ms"),
    (r"(?U)\b\d+(?:\.\d+)?\s*s\b", "[X]s"),
    (r"(?iU)\b\d+(?:\.\d+)?\s*(?:KB|MB|GB|TB)\b", "[X]SIZE"),
)


def normalize_noise(text: Column) -> Column:
    """Times, process ids, durations and sizes become fixed words."""
    return _replace_all(text, *NOISE)


_SCANNED = 64_000


def binary_message(text: Column) -> Column:
    """What stands for a binary text; null for others. More than three NULs in the first 64,000
    characters, and less than a tenth of these characters left without control characters."""
    start = F.substring(text, 1, _SCANNED)
    nuls = F.length(start) - F.length(F.replace(start, F.lit("\0"), F.lit("")))
    clean = _replace_all(F.regexp_replace(start, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""), (r"(?U)\A\s+", ""), (r"(?U)\s+\z", ""))
    ratio = F.length(clean) / F.greatest(F.length(start), F.lit(1))
    return F.when((nuls > 3) & (ratio < 0.1), F.format_string("[Binary output suppressed — %d NUL bytes, %.1f%% text content.]", F.least(nuls, F.lit(4)), ratio * 100))


def oversized_preview(text: Column, limit: int = 500_000) -> Column:
    """Begin and end of a text beyond the limit; null for others."""
    n = F.length(text)
    note = F.concat(F.lit("\n[... Output truncated: "), F.format_number(n, 0), F.lit(f" chars (limit: {limit:,}). Showing first 2,000 and last 1,000 chars. Use targeted queries or narrower tool scope to see the full output. ...]\n"))
    return F.when(n > limit, F.concat(F.substring(text, 1, 2000), note, F.right(text, F.lit(1000))))


def estimated_tokens(chars: Column) -> Column:
    """A quarter of the characters, rounded half to even."""
    return F.bround(chars / 4).cast("long")


#: Brackets, operators and separators.
MARKS = r"[{}()\[\];=<>:,\"'/\\_|&*+#@$%^~`]"


def count_tokens(text: Column) -> Column:
    """Prose: a quarter of the characters, rounded down. Code (over 8 % of brackets, operators and
    separators): one token per 3.2 characters, rounded up."""
    n = F.length(text)
    marks = F.regexp_count(text, F.lit(MARKS))
    return F.when(marks > n * 0.08, F.ceil(n / 3.2)).otherwise(F.floor(n / 4)).cast("long")


def truncate_chars(text: Column, budget: Column | int) -> Column:
    """Begin and end of a text over the budget, with a note of how much is missing between."""
    budget = F.lit(budget) if isinstance(budget, int) else budget
    tail = F.least(F.lit(1024), F.floor(budget / 10).cast("int"))
    head, n = budget - tail, F.length(text)
    note = F.concat(F.lit("\n\n[…truncated "), (n - budget).cast("string"), F.lit(" chars — raise budget or call the tool with a narrower scope…]\n\n"))
    return F.when(n <= budget, text).otherwise(F.concat(F.substring(text, F.lit(1), head), note, F.when(tail > 0, F.right(text, tail)).otherwise("")))


def truncate_tokens(text: Column, budget: int) -> Column:
    """Begin and end within a token budget. Token counts follow from lengths here (see count_tokens), so the
    longest fitting edges have a closed form; what is missing is estimated from the edges' own counts."""
    inner = max(0, budget - 48)
    tail = min(256, inner // 10)
    n, tokens = F.length(text), count_tokens(text)
    per = n / F.greatest(tokens, F.lit(1))
    sizes = F.struct(F.floor(F.lit(inner - tail) * per).cast("int").alias("h"), F.floor(F.lit(tail) * per).cast("int").alias("t"))

    def shown(e: Column) -> Column:
        kept, chars = count_tokens(e["head"]) + count_tokens(e["tail"]), F.length(e["head"]) + F.length(e["tail"])
        whole = F.floor(n * F.when(chars > 0, kept / chars).otherwise(0.25))
        dropped = F.concat(F.greatest(F.lit(0), whole - kept).cast("string"), F.lit(" tokens ("), (n - chars).cast("string"), F.lit(" chars)"))
        note = F.concat(F.lit("\n\n[…truncated ~"), dropped, F.lit(" — raise budget or call the tool with a narrower scope…]\n\n"))
        return F.concat(e["head"], note, e["tail"])

    edges = lambda s: F.struct(F.substring(text, F.lit(1), s["h"]).alias("head"), F.when(s["t"] > 0, F.right(text, s["t"])).otherwise("").alias("tail"))
    cut = F.transform(F.transform(F.array(sizes), edges), shown)[0]
    return F.when(tokens <= budget, text).otherwise(cut)


def human_size(size: Column) -> Column:
    """Bytes as 950, 1.5K, 2.0M, 3.1G; halves of a tenth go to the even one, as fractions of two are exact."""

    def tenths(unit: int) -> Column:
        whole, rest = F.floor(size * 10 / unit), (size * 10) % unit
        up = (rest * 2 > unit) | ((rest * 2 == unit) & (whole % 2 == 1))
        n = F.when(up, whole + 1).otherwise(whole).cast("long")
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))

    out, k = F.when(size < 1024, size.cast("string")), 1024
    return out.when(size < k**2, F.concat(tenths(k), F.lit("K"))).when(size < k**3, F.concat(tenths(k**2), F.lit("M"))).otherwise(F.concat(tenths(k**3), F.lit("G")))


def result_meta(text: Column) -> Column:
    """Exit code and time-out as a tool's own header lines tell them."""
    killed = text.contains("[killed after timeout]")
    code = F.coalesce(F.nullif(F.regexp_extract(text, r"\[exit (-?\d+)\]", 1), F.lit("")), F.nullif(F.regexp_extract(text, r"\b(?:exited|exit) (-?\d+)", 1), F.lit("")))
    return F.struct(F.when(~killed, code.cast("int")).alias("exit_code"), killed.alias("timed_out"))


def savings_percent(raw: Column, filtered: Column) -> Column:
    return F.when(raw > 0, F.bround((raw - filtered) * 100.0 / raw)).otherwise(0).cast("long")
