"""Categories of commands and tools, as one CASE without a join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Package runners before a program, and flags that ask for detail.
_RUNNERS = r"^(?:npx|pnpm|yarn\s+run|yarn|npm\s+run|npm|bun|deno)\s+"
_VERBOSE = r"(?:^|\s)(?:--verbose|-verbose|-v{2,}|--debug|--full|--detailed|--show-all|--no-summary)\b"
#: Programs by category.
LISTERS = ("ls", "dir", "tree", "find")
SEARCHERS = ("grep", "rg", "findstr", "ag", "ack")
TESTERS = ("vitest", "jest", "mocha", "ava", "tape", "tap", "pytest", "py.test", "unittest", "ruby", "rspec", "cucumber")
BUILDERS = ("make", "cmake", "dotnet", "msbuild", "xcodebuild", "bazel", "ninja", "build")
LINTERS = ("eslint", "ruff", "mypy", "clippy", "pylint", "flake8", "rubocop", "shellcheck", "hadolint")
CHECKERS = ("tsc", "tsc-watch", "pyright", "mypy")
SHELL_TOOLS = ("run_command", "run_background", "job_output", "stop_job")
TOOLS = {"read_file": "read_file", "edit_file": "edit_file", "search_content": "search", "wait_for_job": "logs", "list_jobs": "logs", "remember": "generic", "forget": "generic", "recall_memory": "generic", "web_search": "generic", "web_fetch": "generic"}


def is_verbose(command: Column) -> Column:
    return command.rlike(_VERBOSE)


def _trimmed(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\A\s+", ""), r"(?U)\s+\z", "")


def command_base(command: Column) -> Column:
    """The program of a command, without one leading package runner."""
    whole = _trimmed(command)
    return F.split(F.regexp_replace(whole, _RUNNERS, ""), r"\s+")[0]


def command_category(command: Column) -> Column:
    whole, base = _trimmed(command), command_base(command)
    run = r"^(?:npm|pnpm|yarn|bun|deno)\s+"
    has = command.contains
    sub = F.coalesce(F.try_element_at(F.split(whole, r"\s+"), F.lit(2)), F.lit(""))
    git = F.when(sub.isin("status", "diff", "log", "show"), F.concat(F.lit("git-"), sub)).otherwise("git-other")
    gives_json = base.isin("jq", "yq", "json_pp") | ((base == "python3") & has("-m json.tool")) | (base.isin("aws", "gcloud", "az") & (has("--output json") | has("--format json"))) | ((base == "curl") & has("jq")) | (base.isin("npm", "pnpm", "yarn") & has("--json"))
    tests = base.isin(*TESTERS) | (base.isin("cargo", "go") & has(" test")) | (base.isin("mvn", "gradle", "dotnet") & has("test"))
    builds = base.isin(*BUILDERS) | ((base == "cargo") & (has(" build") | has(" check"))) | ((base == "go") & has(" build")) | (base.isin("mvn", "gradle") & (has("compile") | has("build")))
    rules = (
        (whole.rlike(run + r"test\b"), F.lit("test")), (whole.rlike(run + r"run\s+build\b"), F.lit("build")), (whole.rlike(run + r"run\s+lint\b"), F.lit("lint")),
        (whole.rlike(run + r"run\s+type-?check\b"), F.lit("typecheck")), (whole.rlike(run + r"ls\b.*--json"), F.lit("json")),
        (base == "git", git), (base.isin(*LISTERS), F.lit("ls-tree")), (base.isin(*SEARCHERS), F.lit("search")), (gives_json, F.lit("json")), (tests, F.lit("test")), (builds, F.lit("build")),
        (base.isin(*LINTERS) | ((base == "cargo") & has(" clippy")), F.lit("lint")), (base.isin(*CHECKERS) | ((base == "biome") & has("check")), F.lit("typecheck")),
    )
    out = F.when(*rules[0])
    for rule in rules[1:]:
        out = out.when(*rule)
    return out.otherwise("generic")


def tool_category(tool: Column, text: Column) -> Column:
    out = F.when(tool == "raw_output", "passthrough").when(tool.isin(*SHELL_TOOLS), "shell")
    for name, category in TOOLS.items():
        out = out.when(tool == name, category)
    return out.when(tool.startswith("mcp__") & text.rlike(r"(?U)\A\s*[\[{]"), "json").otherwise("generic")


def category(command: Column, tool: Column, text: Column) -> Column:
    """A command decides, else the tool, else the text is generic."""
    return F.when(F.coalesce(command, F.lit("")) != "", command_category(command)).when(F.coalesce(tool, F.lit("")) != "", tool_category(tool, text)).otherwise("generic")
