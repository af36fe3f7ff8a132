"""Framework frames of stack traces, within the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lines as L

#: Forms of stack frames by language, tried in this order, and what a framework's paths begin with.
FRAMES = (
    ("java", r"(?U)^\s+at\s+([\w.$]+)\("),
    ("python", r'(?U)^\s+File\s+"([^"]+)",\s+line\s+\d+,\s+in\s+\w+'),
    ("node", r"(?U)^\s+at\s+\S+\s+\(([^)]+)\)"),
    ("go", r"(?U)^\s+(\S+/\S+)\s+0x[0-9a-fA-F]+"),
)
FRAMEWORKS = (
    "org.springframework.", "org.apache.", "java.lang.reflect.", "jdk.internal.", "io.netty.", "org.gradle.", "org.hibernate.", "com.fasterxml.",
    "org.eclipse.", "sun.reflect.", "org.tomcat.", "javax.servlet.", "/usr/lib/python", "/opt/", "site-packages/", "lib/python", "node:internal", "node_modules/", "runtime/", "internal/",
)
#: What frames of a language other than Java are called.
NAMES = {"python": "Python stdlib", "node": "Node", "go": "Go runtime"}
_FOREIGN = "^(?:" + "|".join(rf"\Q{p}\E" for p in FRAMEWORKS) + ")"
#: A text without this has no frames.
_SIGN = r'(?mU)^\s+(?:at\s|File\s+"|\S+/\S+\s+0x)'


def _tagged(line: Column) -> Column:
    """The line, its language ('' for no frame), its package or path, and whether that is a framework's."""
    lang, path = F.lit(""), F.lit("")
    for name, form in reversed(FRAMES):
        lang, path = F.when(line.rlike(form), name).otherwise(lang), F.when(line.rlike(form), F.regexp_extract(line, form, 1)).otherwise(path)
    return L.let(F.struct(line.alias("line"), lang.alias("lang"), path.alias("path")), lambda t: F.struct(t["line"].alias("line"), t["lang"].alias("lang"), t["path"].alias("path"), t["path"].rlike(_FOREIGN).alias("foreign")))


def _name(frame: Column) -> Column:
    """What a framework's frame is called; null for a path of one part."""
    out = F.when(frame["lang"] == "java", F.when(frame["path"].contains("."), F.substring_index(frame["path"], ".", 2)))
    for lang, name in NAMES.items():
        out = out.when(frame["lang"] == lang, name)
    return out


def _collapsed(run: Column, least: Column) -> Column:
    """Lines of one run of frames of a language, or of lines that aren't frames."""
    plain = lambda frames: F.transform(frames, lambda t: t["line"])
    names = F.array_sort(F.array_distinct(F.filter(F.transform(F.filter(run, lambda t: t["foreign"]), _name), lambda n: n.isNotNull())))
    label = L.let(names, lambda n: F.when(F.size(n) > 0, F.concat(F.lit(" framework frames ("), F.array_join(n, ", "), F.lit(") ...]"))).otherwise(" framework frames ...]"))
    count = lambda n: F.concat(F.lit("[... "), n.cast("string"))
    mixed = L.let(label, lambda what: F.flatten(F.transform(L.islands(run, lambda x, y: x["foreign"] != y["foreign"]), lambda part: F.when(F.get(part, F.lit(0))["foreign"], F.array(F.concat(count(F.size(part)), what))).otherwise(plain(part)))))
    last, first = F.element_at(run, -1)["line"], F.slice(run, 1, 3)
    ends = F.concat(plain(first), F.when(F.size(run) > 3, F.array(F.concat(count(F.size(run) - 3), F.lit(" framework frames omitted ...]")))).otherwise(F.array().cast("array<string>")))
    ends = F.when(F.array_contains(plain(first), last), ends).otherwise(F.concat(ends, F.array(last)))
    short = (F.get(run, F.lit(0))["lang"] == "") | (F.size(run) < least)
    return F.when(short, plain(run)).when(F.forall(run, lambda t: t["foreign"]), ends).otherwise(mixed)


def collapsed_stacks(text: Column, lines: Column, least: Column | int) -> Column:
    """The lines of a text with framework frames between application frames as a note, in runs of at least
    `least` frames of a language; in runs of framework frames alone the first three and the last stay.
    Application frames all stay. `lines`: a column or bound by `let`; no runs where `least` is null."""
    least = F.lit(least) if isinstance(least, int) else least
    runs = L.let(F.transform(lines, _tagged), lambda t: L.let(L.islands(t, lambda x, y: x["lang"] != y["lang"]), lambda r: F.flatten(F.transform(r, lambda run: _collapsed(run, least)))))
    return F.when(text.rlike(_SIGN) & least.isNotNull(), runs).otherwise(lines)
