"""Category filters that stay inside the JVM: text in, struct(output, truncated) out, one row at a time."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import lines as L
from ..functions.text import human_size, normalize_noise
from .stacks import collapsed_stacks

Limit = Column | int
#: Frames of a run that is collapsed, first and last lines, where a filter falls back to generic text.
FRAMES, HEAD, TAIL = 5, 20, 30


def result(output: Column, truncated: Column) -> Column:
    return F.struct(output.alias("output"), truncated.alias("truncated"))


def _body(text: Column, use, prefix: str = L.HEADER) -> Column:
    """use(header lines, body lines), each computed once."""
    return L.let(L.split_lines(text), lambda lines: L.let(L.header_size(lines, prefix), lambda n: L.let(L.after(lines, n), lambda body: use(L.first_of(lines, n), body))))


def _limit(n: Limit) -> Column:
    return F.lit(n) if isinstance(n, int) else n


def _plain(text: Column) -> Column:
    return result(text, F.lit(False))


def _or_generic(own: Column, text: Column, head: Limit = HEAD, tail: Limit = TAIL) -> Column:
    return F.coalesce(own, generic(text, head, tail))


def generic(text: Column, head: Limit = HEAD, tail: Limit = TAIL, frames: Limit | None = FRAMES) -> Column:
    """Header, framework frames collapsed, blank lines thinned, then first and last lines."""
    cut = lambda top: lambda body: result(L.joined(F.concat(top, L.window(body, head, tail))), F.size(body) > _limit(head) + _limit(tail))
    whole = (lambda body: body) if frames is None else (lambda body: collapsed_stacks(text, body, frames))
    return _body(text, lambda top, body: L.let(whole(body), lambda b: L.let(L.collapse_blank(b), cut(top))))


def one_line_log(text: Column, head: Limit, tail: Limit) -> Column:
    """First and last commits of a log of one line each; null for other texts."""

    def use(top: Column, commits: Column) -> Column:
        long = F.size(commits) > _limit(head) + _limit(tail)
        fits = (F.size(commits) > 0) & F.forall(commits, lambda x: x.rlike(r"^[0-9a-f]{6,40}\s"))
        return F.when(fits, result(F.when(long, L.joined(F.concat(top, L.window(commits, head, tail, "commits")))).otherwise(text), long))

    return _body(text, lambda top, body: L.let(F.filter(body, lambda x: ~L.is_blank(x)), lambda c: use(top, c)))


def git_log(text: Column, head: Limit, tail: Limit) -> Column:
    """One-line logs keep their first and last commits; others are generic text."""
    return _or_generic(one_line_log(text, head, tail), text)


#: What makes a log line worth keeping.
IMPORTANT = (
    r"\blistening on\b", r"\blocal:\s+https?://", r"\bhttps?://(?:localhost|127\.0\.0\.1|0\.0\.0\.0)(?::\d+)?\b", r"\b(?:ready|server started|started server|app listening|compiled successfully)\b",
    r"\bbuild complete(?:d)?\b", r"\bready in \d+", r"\bstartup (?:complete|finished)\b", r"\b(?:error|fatal|critical|panic|abort|segfault|core dump)\b",
    r"\b(?:warn(?:ing)?|deprecated|caution)\b", r"\b(?:fail(?:ed|ure)?|exception|unhandled|uncaught)\b",
)
_IMPORTANT = "(?iU)" + "|".join(IMPORTANT)


def logs(text: Column, head: Limit, tail: Limit, most_dupes: int, noise: bool = True) -> Column:
    """Runs of equal lines thinned; of long logs first and last lines, and important ones from between."""

    def cut(top: Column, body: Column) -> Column:
        first, last = L.first_of(body, head), L.last_of(body, tail)
        both = _limit(head) + _limit(tail)
        note = F.concat(F.lit("[... "), (F.size(body) - both).cast("string"), F.lit(" lines omitted ...]"))
        telling = lambda f, l: F.filter(body, lambda x: x.rlike(_IMPORTANT) & ~F.array_contains(f, x) & ~F.array_contains(l, x))  # noqa: E731, E741
        lost = L.let(first, lambda f: L.let(last, lambda l: telling(f, l)))  # noqa: E741
        kept = lambda x: F.when(F.size(x) > 0, F.concat(F.array(F.lit(""), note, F.lit(""), F.lit("Important lines from omitted output:")), x, F.array(F.lit("")))).otherwise(F.array(F.lit(""), note, F.lit("")))
        long = F.size(body) > both
        return result(L.joined(F.when(long, F.concat(top, first, L.let(lost, kept), last)).otherwise(F.concat(top, body))), long)

    return _body(normalize_noise(text) if noise else text, lambda top, body: L.let(L.collapse_runs(body, most_dupes), lambda b: cut(top, b)))


_DONE = r"(?i)BUILD SUCCESSFUL|BUILD SUCCESS|build\s+successful"
_TASK = r"^(?:>\s*Task\s+:(\S+)|\[INFO\]\s+---\s+\S+?:(\S+)\s+)"


def build_summary(text: Column, noise: bool = True) -> Column:
    """Success line, task names and warnings of a successful build; null for other texts."""
    clean, nothing = normalize_noise(text) if noise else text, F.array().cast("array<string>")

    def use(top: Column, body: Column) -> Column:
        tasks = F.transform(F.filter(body, lambda x: x.rlike(_TASK)), lambda x: F.concat(F.regexp_extract(x, _TASK, 1), F.regexp_extract(x, _TASK, 2)))
        more = lambda w: F.when(F.size(w) > 10, F.array(F.concat(F.lit("  [... "), (F.size(w) - 10).cast("string"), F.lit(" more warnings ...]")))).otherwise(nothing)
        warned = lambda w: F.when(F.size(w) > 0, F.concat(F.array(F.lit(""), F.lit("Warnings:")), F.slice(w, 1, 10), more(w))).otherwise(nothing)
        warnings = L.let(F.filter(body, lambda x: ~x.rlike(_TASK) & x.rlike(r"(?i)warning|warn:")), warned)
        done = F.get(F.filter(body, lambda x: x.rlike(_DONE)), F.lit(0))
        out = L.joined(F.concat(top, F.array(done, F.concat(F.lit("Tasks: "), F.array_join(tasks, ", "))), warnings))
        return L.let(out, lambda o: result(o, F.length(o) < F.length(text)))

    own = _body(clean, lambda top, body: L.let(F.transform(body, lambda x: F.trim(x)), lambda b: use(top, b)), L.SHORT_HEADER)
    return F.when(clean.rlike(_DONE) & clean.rlike(r"(?m)^\s*(?:>\s*Task\s+:\S|\[INFO\]\s+---\s+\S+?:\S+\s)"), own)


def build(text: Column, head: Limit, tail: Limit, noise: bool = True) -> Column:
    """Successful builds shrink to their summary; others are generic text."""
    return _or_generic(build_summary(text, noise), normalize_noise(text) if noise else text, head, tail)


_STATUS = r"^([A-Z? !]{2})\s+(.+)$"


def is_status(text: Column) -> Column:
    """Whether the first line of the body that isn't blank is a short status line."""
    return _body(text, lambda _, body: F.coalesce(F.get(F.filter(body, lambda x: ~L.is_blank(x)), F.lit(0)).rlike(_STATUS), F.lit(False)))


def grouped_status(text: Column, most: Limit) -> Column:
    """Short status lines with one status and directory share a line, in the order of their first file;
    null where a line isn't one or the groups are longer than the lines. Grouped by sorting, not pair by pair."""
    path = lambda x: F.regexp_extract(x, _STATUS, 2)
    size = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + F.when(L.is_blank(x), 0).otherwise(F.length(x)))

    def entry(x: Column, i: Column) -> Column:
        key = F.concat(F.regexp_extract(x, _STATUS, 1), F.lit(" "), F.regexp_extract(path(x), r"^(.*/)?[^/]*$", 1))
        return F.struct(key.alias("key"), i.alias("at"), F.regexp_extract(path(x), r"([^/]*)$", 1).alias("name"))

    def group(own: Column) -> Column:
        more = F.when(F.size(own) > _limit(most), F.concat(F.lit(", +"), (F.size(own) - _limit(most)).cast("string"), F.lit(" more"))).otherwise("")
        first = F.get(own, F.lit(0))
        names = F.array_join(F.transform(L.first_of(own, most), lambda e: e["name"]), ", ")
        return F.struct(first["at"].alias("at"), F.concat(first["key"], names, more).alias("line"))

    grouped = lambda entries: F.transform(F.array_sort(F.transform(L.islands(entries, lambda x, y: x["key"] != y["key"]), group)), lambda g: g["line"])

    def use(top: Column, body: Column) -> Column:
        out = lambda g: L.let(L.joined(F.concat(top, g)), lambda o: F.when(size(g) <= size(body), result(o, F.length(o) < F.length(text))))
        lines = F.transform(body, lambda x: F.regexp_replace(x, r"\A\s+|\s+\z", ""))
        entries = lambda clean: F.array_sort(F.transform(clean, entry))
        fits = lambda clean: (F.size(clean) > 0) & F.forall(clean, lambda x: x.rlike(_STATUS))
        return L.let(lines, lambda clean: F.when(fits(clean), L.let(L.let(entries(clean), grouped), out)))

    return _body(text, use)


def git_status(text: Column, head: Limit, tail: Limit, most: Limit) -> Column:
    """Grouped status lines, or generic text: with the limits if it begins like a short status."""
    status = is_status(text)
    return _or_generic(grouped_status(text, most), text, F.when(status, _limit(head)).otherwise(HEAD), F.when(status, _limit(tail)).otherwise(TAIL))


#: Line beginnings that head a file's section of a diff.
DIFF_HEADS = ("diff --git", "diff --cc", "index ", "--- ", "+++ ", "@@", "old mode", "new mode", "similarity index", "rename from", "rename to", "copy from", "copy to", "deleted file mode", "new file mode")
_FILE, _HEADS = r"^diff --(?:git|cc)", "^(?:" + "|".join(rf"\Q{h}\E" for h in DIFF_HEADS) + ")"


def _first_place(lines: Column, pattern: str) -> Column:
    """Place (from 1) of the first line with a pattern, 0 if there is none."""
    return F.array_position(F.transform(lines, lambda x: x.rlike(pattern)), True)


def _section(part: Column, most: Limit) -> Column:
    """A file's section: its head lines, and changed lines by their rank from both ends."""
    heads = F.array_position(F.transform(part, lambda x: ~x.rlike(_HEADS)), True).cast("int")
    top = F.when(heads == 0, F.size(part)).otherwise(heads - 1)
    budget = F.greatest(F.lit(2), F.ceil(_limit(most) / 3).cast("int"))

    def shortened(body: Column, changed: Column) -> Column:
        shown = L.let(F.when(F.size(changed) > 0, changed).otherwise(body), lambda c: chosen(c, F.when(F.size(changed) > 0, F.floor(budget / 2).cast("int")).otherwise(budget - 1)))
        note = lambda kept: F.array(F.lit(""), F.concat(F.lit("[... "), (F.size(body) - F.size(kept)).cast("string"), F.lit(" lines omitted in this file ...]")), F.lit(""))
        return L.let(shown, lambda kept: F.when((F.size(part) <= _limit(most)) | (F.size(body) <= 3) | (F.size(kept) >= F.size(body)), part).otherwise(F.concat(L.first_of(part, top), kept, note(kept))))

    chosen = lambda c, first: F.when(F.size(c) <= budget, c).otherwise(F.concat(L.first_of(c, first), L.last_of(c, budget - first)))
    return L.let(L.after(part, top), lambda body: L.let(F.filter(body, lambda x: x.rlike(r"^(?:\+(?!\+\+)|-(?!--))")), lambda changed: shortened(body, changed)))


def _sections(diff: Column, most: Limit) -> Column:
    return F.flatten(F.transform(L.islands(diff, lambda _, x: x.rlike(_FILE)), lambda part: _section(part, most)))


def diff_sections(text: Column, most: Limit, tail: Limit) -> Column:
    """A diff with every file's section shortened; null for texts without one."""

    def use(top: Column, body: Column, at: Column) -> Column:
        diff = L.after(body, at - 1)
        short = F.size(body) - at + 1 <= _limit(most) + _limit(tail)
        own = L.let(diff, lambda d: result(L.joined(F.concat(top, L.first_of(body, at - 1), _sections(d, most))), F.lit(True)))
        return F.when(at > 0, F.when(short, _plain(text)).otherwise(own))

    return _body(text, lambda top, body: L.let(_first_place(body, _FILE).cast("int"), lambda at: use(top, body, at)))


def git_diff(text: Column, most: Limit, tail: Limit) -> Column:
    """Diffs by file; other texts are generic."""
    return _or_generic(diff_sections(text, most, tail), text)


def commit_sections(text: Column, most: Limit, tail: Limit) -> Column:
    """A commit's own lines whole and its diff by file; null for texts without both."""

    def use(top: Column, body: Column, at: Column) -> Column:
        long = F.size(body) - at + 1 > _limit(most) + _limit(tail)
        own = L.let(L.after(body, at - 1), lambda d: result(L.joined(F.concat(top, L.first_of(body, at - 1), _sections(d, most))), F.lit(True)))
        return F.when(F.size(body) == 0, _plain(text)).when(at > 1, F.when(long, own).otherwise(_plain(text)))

    return _body(text, lambda top, body: L.let(_first_place(body, _FILE).cast("int"), lambda at: use(top, body, at)))


#: First and last lines of a shown object without a diff.
SHOW_HEAD, SHOW_TAIL = 40, 20


def git_show(text: Column, most: Limit, tail: Limit) -> Column:
    """A commit's own lines whole and its diff by file; others are generic."""
    return _or_generic(commit_sections(text, most, tail), text, SHOW_HEAD, SHOW_TAIL)


_HIT, _PATH = r"^([^:\s]+?):(\d+)[:-]", r"(?U)^[^\s:]\S*[^\s:]:?$"


def _grouped_hits(filled: Column) -> Column:
    """Runs of matches in one file: path, whether it was a heading, its lines."""

    def mark(line: Column, i: Column) -> Column:
        after = F.coalesce(F.get(filled, i + 1), F.lit(""))
        own = lambda x: F.struct(i.alias("at"), (x.rlike(_PATH) & ~x.rlike(_HIT) & (x.endswith(":") | L.stripped(after).rlike(r"^\d+[:-]"))).alias("heading"), x.alias("x"))
        path = lambda m: F.when(m["heading"], F.regexp_replace(m["x"], ":+$", "")).when(m["x"].rlike(_HIT), F.regexp_extract(m["x"], _HIT, 1))
        return L.let(L.let(L.stripped(line), own), lambda m: F.struct(m["at"].alias("at"), m["heading"].alias("heading"), path(m).alias("path")))

    def starts(marks: Column) -> Column:
        own = F.filter(marks, lambda m, k: m["heading"] | F.when(k == 0, True).otherwise(F.get(marks, k - 1)["path"] != m["path"]))
        loose = F.array(F.struct(F.lit(0).alias("at"), F.lit(False).alias("heading"), F.lit("(unsorted)").alias("path")))
        return F.when(F.coalesce(F.get(marks, F.lit(0))["at"], F.lit(1)) > 0, F.concat(loose, own)).otherwise(own)

    def cut(s: Column) -> Column:
        begin = lambda g: g["at"] + g["heading"].cast("int")
        own = lambda g, k: F.slice(filled, begin(g) + 1, F.coalesce(F.get(s, k + 1)["at"], F.size(filled)) - begin(g))
        return F.filter(F.transform(s, lambda g, k: F.struct(g["path"].alias("path"), g["heading"].alias("heading"), own(g, k).alias("own"))), lambda g: F.size(g["own"]) > 0)

    marks = F.filter(F.transform(filled, mark), lambda m: m["path"].isNotNull())
    return F.when(F.size(filled) > 0, L.let(L.let(marks, starts), cut)).otherwise(F.array().cast("array<struct<path:string,heading:boolean,own:array<string>>>"))


def _under_heading(line: Column, whole: bool) -> Column:
    own = lambda x: F.when(x.rlike(_HIT), F.concat(F.lit("  "), F.regexp_extract(x, _HIT, 2), F.lit(": "), F.regexp_replace(x, _HIT, ""))).otherwise(F.concat(F.lit("  "), x) if whole else line)
    return L.let(L.stripped(line), own)


def matches_by_file(text: Column, most: Limit, files: Limit, reformat: bool = True) -> Column:
    """Matches by file, the first of each and the first files; few are only brought under headings. Null
    for texts without matches, unless they are very short."""
    most, files = _limit(most), _limit(files)
    noted = lambda g: F.concat(L.first_of(g["own"], most), F.when(F.size(g["own"]) > most, F.array(F.concat(F.lit("  [... "), (F.size(g["own"]) - most).cast("string"), F.lit(" more matches in "), g["path"], F.lit(" ...]")))).otherwise(F.array().cast("array<string>")))

    def brief(groups: Column) -> Column:
        each = lambda g: F.when(g["heading"], g["own"]).otherwise(F.concat(F.array(g["path"]), F.transform(g["own"], lambda x: _under_heading(x, True))))
        return F.flatten(F.transform(groups, each))

    def capped(groups: Column) -> Column:
        def each(g: Column, k: Column) -> Column:
            gap = F.when((k > 0) & (F.get(groups, k - 1)["path"] != g["path"]), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
            name = F.array(g["path"]) if reformat else F.when(g["heading"], F.array(g["path"])).otherwise(F.array().cast("array<string>"))
            own = F.when(g["heading"], noted(g)).otherwise(F.transform(noted(g), lambda x: _under_heading(x, False))) if reformat else noted(g)
            return F.concat(gap, name, own)

        rest = L.after(groups, files)
        hits = F.aggregate(rest, F.lit(0), lambda n, g: n + F.size(g["own"]))
        foot = F.when(F.size(groups) > files, F.array(F.lit(""), F.concat(F.lit("[... "), (F.size(groups) - files).cast("string"), F.lit(" more files with "), hits.cast("string"), F.lit(" matches omitted ...]")))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.flatten(F.transform(L.first_of(groups, files), each)), foot)

    def use(top: Column, groups: Column) -> Column:
        few = (F.size(groups) <= files) & F.forall(groups, lambda g: F.size(g["own"]) <= most)
        short = L.let(L.joined(F.concat(top, brief(groups))), lambda o: result(o, F.length(o) < F.length(text))) if reformat else _plain(text)
        return F.when(F.size(groups) == 0, _plain(text)).when(few, short).otherwise(result(L.joined(F.concat(top, capped(groups))), F.lit(True)))

    def body(top: Column, filled: Column) -> Column:
        heading = lambda x, i: L.let(L.stripped(x), lambda y: y.rlike(_PATH) & ~y.rlike(_HIT) & (y.endswith(":") | L.stripped(F.coalesce(F.get(filled, i + 1), F.lit(""))).rlike(r"^\d+[:-]")))
        found = F.exists(filled, lambda x: x.rlike(r"[^:\s]+:\d+[:-]")) | F.exists(F.transform(filled, heading), lambda x: x)
        return F.when(found, L.let(_grouped_hits(filled), lambda g: use(top, g))).when(F.size(filled) <= 3, _plain(text))

    return _body(text, lambda top, lines: L.let(F.filter(lines, lambda x: ~L.is_blank(x)), lambda filled: body(top, filled)))


def search(text: Column, most: Limit, files: Limit, head: Limit, tail: Limit, reformat: bool = True) -> Column:
    """Matches by file; other texts are generic."""
    return _or_generic(matches_by_file(text, most, files, reformat), text, head, tail)


#: Forms of listing lines, and beginnings of names in listings worth keeping.
LS_LINE = r"^([dlcbps-][-rwxsStT]{9})\s+(\d+)\s+(\S+)\s+(\S+)\s+(\d+)\s+(.+)$"
LS_DATE = r"\s+\d{1,2}\s+\d{2}:\d{2}(?=\s)|\s+\d{1,2}\s+\d{4}(?=\s)"
LS_TOTAL = r"^total\s+\d+"
LS_ERROR = r"(?i)Permission denied|No such file|not found|cannot access|cannot open"
KEPT_NAMES = (
    r"^package\.json$", r"^tsconfig\.json$", r"^Cargo\.toml$", r"^pyproject\.toml$", r"^go\.mod$", r"^Makefile$", r"^Dockerfile$", r"^docker-compose", r"^\.env", r"^README",
    r"^CHANGELOG", r"^LICENSE", r"^\.gitignore$", r"^\.gitmodules$", r"^src$", r"^lib$", r"^test", r"^spec", r"^__tests__$", r"^src/", r"^lib/",
)
_KEPT, _TREE = "(?i)" + "|".join(KEPT_NAMES), r"^[│├└─┌┘┐]|\s[│├└─]"


def _short_entry(line: Column) -> Column:
    """Name and size of a long listing's line; other lines as they are."""

    def use(x: Column) -> Column:
        part = lambda k: F.regexp_extract(x, LS_LINE, k)
        dated, words = rf"^.*?(?:{LS_DATE})(.*)$", F.split(L.stripped(part(6)), r"\s+")
        name = F.when(part(6).rlike(LS_DATE), L.stripped(F.regexp_extract(part(6), dated, 1))).when(F.size(words) >= 4, F.array_join(F.slice(words, 4, 1 << 30), " ")).otherwise(part(6))
        links = part(2).cast("long") - 2
        entries = F.when(links > 0, F.concat(F.lit(", "), links.cast("string"), F.lit(" entries"))).otherwise("")
        shown = lambda n: F.when(part(1).startswith("d"), F.concat(n, F.lit("/             (dir"), entries, F.lit(")"))).otherwise(F.concat(n, F.lit("     "), human_size(part(5).cast("long"))))
        split = lambda n: F.concat(shown(F.regexp_extract(n, "^(.*?)(?: -> .*)?$", 1)), F.regexp_extract(n, "^.*?( -> .*)?$", 1))
        return F.when(x.rlike(LS_LINE), L.let(name, split)).otherwise(line)

    return L.let(L.stripped(line), use)


def listed_entries(text: Column, most: Limit, tables: bool = True, long_form: bool = True) -> Column:
    """Long listings shrink to names and sizes; of others with many entries the important ones stay, and
    the first and last of the rest. Null for trees."""
    most, nothing = _limit(most), F.array().cast("array<string>")

    def long_listing(top: Column, body: Column) -> Column:
        totals = F.slice(F.transform(F.filter(body, lambda x: L.stripped(x).rlike(LS_TOTAL)), L.stripped), 1, 1)
        rest = F.transform(F.filter(body, lambda x: ~L.stripped(x).rlike(LS_TOTAL)), lambda x: F.when(L.is_blank(x), "").when(x.rlike(LS_ERROR), x).otherwise(_short_entry(x)))
        return L.let(L.joined(F.concat(top, totals, rest)), lambda o: result(o, F.length(o) < F.length(text)))

    def entry(x: Column, i: Column) -> Column:
        own = lambda name: F.struct(F.when(F.substring_index(F.regexp_replace(name, "/+$", ""), "/", -1).rlike(_KEPT), name).otherwise(F.concat(F.lit("\0"), i.cast("string"))).alias("key"), i.alias("at"), x.alias("line"))
        return L.let(L.stripped(x), own)

    def split(filled: Column) -> Column:
        """The entries in order, each with whether it is the first important one of its name."""
        runs = L.let(F.array_sort(F.transform(filled, entry)), lambda e: L.islands(e, lambda x, y: x["key"] != y["key"]))
        marked = F.flatten(F.transform(runs, lambda run: F.transform(run, lambda e, k: F.struct(e["at"].alias("at"), (~e["key"].startswith("\0") & (k == 0)).alias("kept"), e["line"].alias("line")))))
        return F.array_sort(marked)

    def shortened(top: Column, body: Column, entries: Column) -> Column:
        lines = lambda own: F.transform(F.filter(entries, own), lambda e: e["line"])

        def use(kept: Column, regular: Column, errors: Column) -> Column:
            room = most - F.size(kept) - F.size(errors)
            first = F.greatest(F.lit(0), F.floor(room / 2).cast("int"))
            last = F.greatest(F.lit(0), room - first)
            note = F.concat(F.lit("[... "), (F.size(regular) - first - last).cast("string"), F.lit(" entries omitted ...]"))
            shown = F.concat(top, F.when(F.size(kept) > 0, F.concat(kept, F.array(F.lit("")))).otherwise(nothing), L.first_of(regular, first), F.array(F.lit(""), note, F.lit("")), L.last_of(regular, last))
            whole = L.let(shown, lambda out: result(L.joined(F.concat(out, F.filter(errors, lambda x: ~F.array_contains(out, x)))), F.lit(True)))
            return F.when(F.size(regular) <= room, _plain(L.joined(F.concat(top, body)))).otherwise(whole)

        return L.let(lines(lambda e: e["kept"]), lambda k: L.let(lines(lambda e: ~e["kept"]), lambda r: L.let(F.filter(body, lambda x: x.rlike(LS_ERROR)), lambda e: use(k, r, e))))

    def use(top: Column, body: Column) -> Column:
        filled = F.filter(body, lambda x: ~L.is_blank(x))

        def of(own: Column) -> Column:
            entries = F.filter(own, lambda x: ~L.stripped(x).rlike(LS_TOTAL))
            parsed = F.size(F.filter(entries, lambda x: L.stripped(x).rlike(LS_LINE)))
            is_long = (F.size(entries) >= 3) & (parsed >= F.size(own) * 0.6) if long_form else F.lit(False)
            many = L.let(split(own), lambda e: shortened(top, body, e))
            return F.when(is_long, long_listing(top, body)).when(F.size(own) <= most, _plain(L.joined(F.concat(top, body)))).otherwise(many)

        tree = F.exists(body, lambda x: x.rlike(_TREE))
        return F.when(F.size(body) == 0, _plain(text)).when(~tree, L.let(filled, of))

    clean = lambda body: F.transform(body, _narrow_cells) if tables else body
    return _body(text, lambda top, body: L.let(clean(body), lambda b: use(top, b)))


def listing(text: Column, most: Limit, head: Limit, tail: Limit, tables: bool = True, long_form: bool = True) -> Column:
    """Listings by entry; trees are generic text."""
    return _or_generic(listed_entries(text, most, tables, long_form), text, head, tail)


def _narrow_cells(line: Column) -> Column:
    piped = F.length(line) - F.length(F.replace(line, F.lit("|"), F.lit(""))) >= 2
    return F.when(piped, F.array_join(F.transform(F.split(line, r"\|", -1), L.stripped), "|")).otherwise(line)


def minimized_tables(text: Column) -> Column:
    """Cells of piped tables without padding."""
    return L.joined(F.transform(L.split_lines(text), _narrow_cells))
