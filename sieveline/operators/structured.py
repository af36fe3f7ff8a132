"""Source files and JSON, whose filters scan with state or keep a document's own form: one Arrow UDF.

A row's text goes to the filter its category names; rows of other categories cross as nulls. Every row is
guarded by itself: a text that a filter fails on comes back unchanged with `failed` set. Text that isn't
JSON comes back null, and is generic text to the caller.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import boosted
from .filters import generic

Lines = list[str]

#: Lines that a tool puts before JSON.
_HEAD = ("$ ", "[exit", "[killed")


def _header(lines: Lines) -> int:
    return next((k for k, x in enumerate(lines) if x and not x.startswith(_HEAD)), len(lines))


# ---- JSON -----------------------------------------------------------------------------------------


def _is_flat(v: object) -> bool:
    return not isinstance(v, (dict, list))


def _is_table(v: object, least: int) -> bool:
    """Flat objects whose keys mostly agree."""
    if not isinstance(v, list) or len(v) < least or not all(isinstance(r, dict) and r and all(map(_is_flat, r.values())) for r in v):
        return False
    keys = {k for r in v for k in r}
    return sum(sum(k in r for r in v) >= 0.8 * len(v) for k in keys) >= 0.6 * len(keys)


def _cell(v: object) -> str:
    return "" if v is None else str(v).lower() if isinstance(v, bool) else str(v)


def _quoted(x: str) -> str:
    return '"' + x.replace('"', '""') + '"' if re.search(r'[",\n\r]', x) else x


def _csv(rows: list[dict], cfg: dict) -> str:
    width, most = cfg["json_csv_max_key_length"], cfg["json_csv_max_rows"]
    keys = list(dict.fromkeys(k for r in rows for k in r))
    common: dict[str, str] = {}
    for k in keys if cfg.get("json_csv_factor", True) else ():
        counts: dict[str, int] = {}
        for r in rows:
            if k in r:
                counts[_cell(r[k])] = counts.get(_cell(r[k]), 0) + 1
        value = max(counts, key=lambda v: counts[v])  # of equal counts the one seen first
        if counts[value] >= cfg["json_csv_factor_threshold"] * len(rows) and len(common) < cfg["json_csv_factor_max_columns"]:
            common[k] = value
    shown = [k for k in keys if k not in common or any(_cell(r.get(k)) != common[k] for r in rows)]
    out = [f"{k[:width]}={v}" for k, v in common.items()] + [""] * bool(common)
    out.append(",".join(_quoted(k[:width]) for k in shown))
    out += [",".join("" if k in common and _cell(r.get(k)) == common[k] else _quoted(_cell(r.get(k))) for k in shown) for r in rows[:most]]
    if len(rows) > most:
        out.append(f"[... {len(rows) - most} more rows, keys: {', '.join(k[:width] for k in keys[:5])}{', ...' if len(keys) > 5 else ''}]")
    return "\n".join(out)


def _leaf(v: object, width: int) -> str:
    if not isinstance(v, str):
        return json.dumps(v)
    if len(v) > width:
        return f'"{v[:width]}..."' if "\n" in v else f'"{v[:width]}..." [{len(v)} chars]'
    return json.dumps(v) if "\n" in v else v


def _leaves(v: dict, depth: int) -> Iterator[tuple[str, object]]:
    """Dotted paths of an object's leaves; raises where it is too deep or holds a list."""
    if depth <= 0:
        raise ValueError("too deep")
    for k, x in v.items():
        if isinstance(x, list):
            raise ValueError("a list")
        if isinstance(x, dict):
            yield from ((f"{k}.{p}", y) for p, y in _leaves(x, depth - 1))
        else:
            yield k, x


def _pairs(pairs: list[tuple[str, object]], most: int, width: int, cut_always: bool, cfg: dict) -> str:
    cut = width if cut_always or len(pairs) > most else None
    out = [f"{k[:cut]}: {_leaf(v, cfg['json_max_value_length'])}" for k, v in pairs[:most]]
    if len(pairs) > most:
        out.append(f"... +{len(pairs) - most} more keys: [{', '.join(k for k, _ in pairs[most : most + 5])}]")
    return "\n".join(out)


def _nested(v: object, depth: int, cfg: dict) -> str:
    """The value with long strings, arrays and objects cut at every level."""
    width, pad, end = cfg["json_max_value_length"], "  " * (depth + 1), "  " * depth
    if isinstance(v, str) and len(v) > width:
        return f"{json.dumps(v[:width])}... [{len(v)} chars]"
    if _is_flat(v) or not v:
        return json.dumps(v)
    deep = depth >= cfg["json_max_depth"]
    if isinstance(v, list):
        most = cfg["json_max_array_items"]
        if deep:
            return f"[... {len(v)} items]"
        items = [_nested(x, depth + 1, cfg) for x in v[:most]] + ([f"... +{len(v) - most} more items"] if len(v) > most else [])
        return f"[\n{pad}" + f",\n{pad}".join(items) + f"\n{end}]"
    most, keys = cfg["json_max_keys_per_object"], list(v)
    if deep:
        return f"{{... {len(keys)} keys}}"
    items = [f"{pad}{json.dumps(k)}: {_nested(v[k], depth + 1, cfg)}" for k in keys[:most]]
    if len(keys) > most:
        items.append(f"{pad}... +{len(keys) - most} more keys: [{', '.join(keys[most:])}]")
    return "{\n" + ",\n".join(items) + f"\n{end}}}"


def _reshaped(v: object, cfg: dict) -> str | None:
    """A shorter notation for tables, nested objects without lists, and flat objects."""
    width = cfg["json_csv_max_key_length"]
    if cfg.get("json_csv", True) and _is_table(v, cfg["json_csv_min_rows"]):
        return _csv(v, cfg)
    if isinstance(v, dict):
        if cfg.get("json_dotkey", True) and any(isinstance(x, dict) for x in v.values()):
            try:
                return _pairs(list(_leaves(v, cfg["json_dotkey_max_depth"])), cfg["json_dotkey_max_keys"], width, False, cfg)
            except ValueError:
                pass
        if cfg.get("json_kv", True) and len(v) >= cfg["json_kv_min_keys"] and all(map(_is_flat, v.values())):
            return _pairs(list(v.items()), cfg["json_kv_max_keys"], width, True, cfg)
    return None


def json_text(text: str, cfg: dict) -> tuple[str | None, bool | None]:
    lines = text.split("\n")
    n = _header(lines)
    body = "\n".join(lines[n:])
    if not body.strip():
        return text, False
    try:
        value = json.loads(body)
    except ValueError:
        return None, None
    cut, other = _nested(value, 0, cfg), _reshaped(value, cfg)
    out = "\n".join([*lines[:n], other if other is not None and len(other) <= len(cut) else cut])
    return out, len(out) < len(text)


# ---- source files ---------------------------------------------------------------------------------

#: Forms of imports and comments, and of lines that declare something.
IMPORT = r"^\s*(?:from\s+\S+\s+)?import\s+"
COMMENT = r"^\s*(?:#\s|//\s?|/\*|\*\s|\*/)"
LINE_COMMENT = r"^\s*(?://|#)\s"
DECLARATION = (
    r"^\s*"
    r"(?:"
    r"(?:class|def|async\s+def|function|const|let|var|type|interface|enum|namespace|module|export|pub|fn|struct|impl|trait)\s"
    r"|(?:@\w+)"
    r"|(?:(?:public|private|protected|static|final|abstract|override)\s+)+\w+\s*[\(<]"
    r"|(?:\w[\w\-]*\s*\.[\w\-]+\s*\()"
    r")"
)
_IMPORT, _COMMENT, _LINE_COMMENT = re.compile(IMPORT), re.compile(COMMENT), re.compile(LINE_COMMENT)
_LITERAL = re.compile(r"^\s*(?:(?:const|let|var)\s+)?\w+\s*[:=].*?([\[{])\s*$")
_CSS = re.compile(r"^\s*[.#@\w*:\[][^{};=]*\{\s*$")
_STRINGS = ('"""', "'''", "`")


def _minified(line: str) -> bool:
    x = line.strip()
    dense = lambda mark, least, per: (n := x.count(mark)) >= least and len(x) < per * n
    return len(x) >= 200 and (dense(";", 5, 40) or dense(",", 10, 20))


def _until(lines: Lines, at: int, done: Callable[[str], bool]) -> int:
    """Behind the first line from `at` on that ends a block, or behind the last line."""
    return next((k + 1 for k in range(at, len(lines)) if done(lines[k])), len(lines))


def _while(lines: Lines, at: int, same: Callable[[str], bool]) -> int:
    return next((k for k in range(at, len(lines)) if not same(lines[k])), len(lines))


def _bracket_end(lines: Lines, at: int, opened: str) -> int:
    closed, depth = {"[": "]", "{": "}"}[opened], 0
    for k in range(at, len(lines)):
        x = lines[k][lines[k].rfind(opened) :] if k == at else lines[k]
        depth += x.count(opened) - x.count(closed)
        if depth <= 0:
            return k + 1
    return len(lines)


def _block(lines: Lines, at: int, cfg: dict) -> tuple[int, Lines]:
    """Where the construct that begins at a line ends, and what stands for it (nothing: itself)."""
    x = lines[at]
    brief = lambda end, n, what, last=False: (end, [x, f" [... {n} {what} lines omitted ...]", *([lines[end - 1]] if last else [])])
    literal = cfg["read_literal_threshold"]
    if not x.strip():
        return at + 1, []
    if cfg.get("read_import_collapse", True) and _IMPORT.match(x):
        end = _while(lines, at, lambda y: bool(_IMPORT.match(y)))
        return brief(end, end - at - 1, "import") if end - at > 3 else (end, [])
    if cfg["read_comment_threshold"] > 0 and _COMMENT.match(x):
        block = x.lstrip().startswith("/*") and "*/" not in x
        end = _until(lines, at, lambda y: "*/" in y) if block else max(at + 1, _while(lines, at, lambda y: bool(_LINE_COMMENT.match(y))))
        return brief(end, end - at - 1, "comment") if end - at > cfg["read_comment_threshold"] else (end, [])
    if literal > 0:
        if quote := next((q for q in _STRINGS if x.count(q) % 2), None):
            end = _until(lines, at + 1, lambda y: quote in y)
            return brief(end, end - at - 2, "multiline string", True) if end - at > literal else (end, [])
        if m := _LITERAL.match(x):
            end = _bracket_end(lines, at, m[1])
            kind = "array literal" if m[1] == "[" else "object literal" if re.match(r"\s*(?:const|let|var)\b", x) else "dict literal"
            return brief(end, end - at - 2, kind, True) if end - at > literal else (end, [])
        if "JSON.parse(" in x and re.match(r"\s*(?:(?:const|let|var)\s+)?\w+\s*[:=]\s*JSON\.parse\(", x) and x.rstrip()[-1:] in "[{":
            end = _bracket_end(lines, at, x.rstrip()[-1])
            return brief(end, end - at - 2, "embedded JSON", True) if end - at > literal else (end, [])
    if cfg.get("read_css_rule_collapse", True) and _CSS.match(x):
        end = _until(lines, at + 1, lambda y: "}" in y)
        n = end - at - 2
        return (end, [x, f" [... {n} CSS body lines omitted ...]", "}"]) if n > 3 else (end, [])
    if re.search(r"<svg[\s>]", x) and "</svg>" not in x:
        end = _until(lines, at, lambda y: "</svg>" in y)
        drawn = any(re.search(r'[dD]\s*=\s*"[Mm]', y) for y in lines[at:end])
        return brief(end, end - at - 2, "SVG path/body", True) if drawn and end - at > 6 else (end, [])
    odd = lambda y: bool(y.strip()) and (len(y) >= cfg["read_generated_min_line_len"] or _minified(y))
    if cfg["read_generated_min_run"] > 0 and odd(x):
        end = _while(lines, at, odd)
        if end - at >= cfg["read_generated_min_run"]:
            return brief(end, end - at - 1, "minified" if _minified(x) else "generated")
        # a run that is too short takes the line after it along, whatever that begins
        return (end + 1 if end < len(lines) and lines[end].strip() else end), []
    return at + 1, []


def read_file(text: str, cfg: dict) -> tuple[str, bool]:
    lines, out, at = text.split("\n"), [], 0
    while at < len(lines):
        end, instead = _block(lines, at, cfg)
        out += instead or lines[at:end]
        at = end
    keep, kept, blanks = max(1, cfg["read_blank_line_max"]), [], 0
    for x in out:
        blanks = 0 if x.strip() else blanks + 1
        if blanks <= keep:
            kept.append(x)
    shown = "\n".join(kept)
    return shown, len(shown) < len(text)


# ---- dispatch -------------------------------------------------------------------------------------

FILTERS: dict[str, Callable[[str, dict], tuple[str | None, bool | None]]] = {"read_file": read_file, "json": json_text}
_OUT = "output string, truncated boolean, failed boolean"


def filtered(category: Column, text: Column, cfg: dict, detailed: Column | None = None) -> Column:
    """struct(output, truncated, failed) of rows whose category is in FILTERS; output is null for others and
    for text that isn't JSON. `detailed`: rows that get the doubled limits."""
    more = boosted(cfg)

    @F.pandas_udf(_OUT)
    def run(kind: pd.Series, texts: pd.Series, detailed: pd.Series) -> pd.DataFrame:
        rows = []
        for k, t, d in zip(kind, texts, detailed, strict=True):
            if k not in FILTERS or t is None:
                rows.append((None, None, None))
                continue
            try:
                rows.append((*FILTERS[k](t, more if d else cfg), False))
            except Exception:  # one text must not stop the others
                rows.append((t, False, True))
        return pd.DataFrame(rows, columns=["output", "truncated", "failed"])

    own = category.isin(*FILTERS)
    return run(F.when(own, category), F.when(own, text), F.lit(False) if detailed is None else F.coalesce(detailed, F.lit(False)))


def apply(texts: DataFrame, category: str, text: Column, cfg: dict) -> DataFrame:
    """Adds output, truncated, failed."""
    own, other = F.col("__r.output").isNotNull(), F.struct(F.col("__g.output"), F.col("__g.truncated"), F.lit(False).alias("failed"))
    out = texts.withColumn("__r", filtered(F.lit(category), text, cfg)).withColumn("__g", F.when(~own, generic(text)))
    return out.withColumn("__r", F.when(own, F.col("__r")).otherwise(other)).select("*", "__r.*").drop("__r", "__g")


_PATH = re.compile(r"""(?:[A-Za-z]:[\\/]|(?<!\w)/|(?<![/\\\w])(?:\.\.?[\\/])?\w+[/\\])(?:[^\s:*?"<>|]+[\\/])*[^\s:*?"<>|]+""")


def normalize_paths(text: Column, roots: tuple[str, ...], workspace: str = "") -> Column:
    """Paths below a root lose it (below the workspace, all but the root's own name); all get forward slashes."""
    known = sorted((r.replace("\\", "/") for r in roots), key=len, reverse=True)

    def shorter(m: re.Match) -> str:
        path = m[0].replace("\\", "/")
        root = next((r for r in known if path.startswith(r + "/")), None)
        if root is None:
            return path
        inside = workspace and root.startswith(workspace + "/")
        return (root.rsplit("/", 1)[1] + "/" if inside else "") + path[len(root) + 1 :]

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else _PATH.sub(shorter, t))

    return F.when(text.rlike(r"[/\\]"), run(F.when(text.rlike(r"[/\\]"), text))).otherwise(text) if known else text
