"""Checks of a repository's files: generated code, licences, locks, workflows, owners, secrets, agents.

Inputs are tables of files (path, text) or of paths. Texts are looked at in
their own rows; only names and keys are shuffled.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import exprs as X
from .rules import finding

# fixed values -------------------------------------------------------------------------------------
GENERATED = r"(?i)(?<!\bnot )(auto[- ]?generated|generated (by|from|file|code|automatically|with))|do not (edit|modify)|@generated|code generated"
GENERATED_NAME = r"(?i)\.(min\.js|min\.css|bundle\.js|map)$|(^|/)dist/"
GENERATED_LINES = 5
# fixed values: licence ids without obligations, and the beginnings of those with weak and with strong copyleft
PERMISSIVE = frozenset(
    "MIT MIT-0 ISC 0BSD APACHE-2.0 APACHE-1.1 UNLICENSE BSL-1.0 CC0-1.0 ZLIB PYTHON-2.0 PSF-2.0 BLUEOAK-1.0.0 CC-BY-3.0 CC-BY-4.0 CURL X11 WTFPL ARTISTIC-2.0 NCSA UPL-1.0"
    " POSTGRESQL OPENSSL PHP-3.01 RUBY UNICODE-3.0 UNICODE-DFS-2016 BSD-2-CLAUSE BSD-3-CLAUSE MPL-2.0-NO-COPYLEFT-EXCEPTION".split()
)
WEAK_COPYLEFT = ("LGPL-", "MPL-", "EPL-", "CDDL-", "CPL-", "MS-RL", "CC-BY-SA-")
STRONG_COPYLEFT = ("GPL-", "AGPL-", "SSPL-", "EUPL-", "OSL-")
MAGIC = (("ELF", "7f454c46"), ("PE", "4d5a"), ("Mach-O", "cffaedfe"), ("Mach-O", "feedfacf"), ("Java class", "cafebabe"), ("zip", "504b0304"), ("gzip", "1f8b"), ("wasm", "0061736d"))
POLICIES = {"readme": r"(?i)^readme(\.|$)", "licence": r"(?i)^(licen[cs]e|copying)(\.|-|_|$)", "contributing": r"(?i)^(\.github/|docs/)?contributing(\.|$)", "security": r"(?i)^(\.github/|docs/)?security(\.|$)", "codeowners": r"(?i)^(\.github/|docs/|\.gitlab/)?codeowners$", "changelog": r"(?i)^(changelog|changes|history|news)(\.|$)"}
ECOSYSTEM_FILES = {"npm": r"(^|/)package\.json$", "pip": r"(^|/)(requirements[^/]*\.txt|pyproject\.toml|setup\.py)$", "gomod": r"(^|/)go\.mod$", "cargo": r"(^|/)Cargo\.toml$", "github-actions": r"^\.github/workflows/[^/]+\.ya?ml$", "docker": r"(^|/)Dockerfile$"}
LOCKS = {"package.json": ("package-lock.json", "yarn.lock", "pnpm-lock.yaml"), "Cargo.toml": ("Cargo.lock",), "go.mod": ("go.sum",), "pyproject.toml": ("poetry.lock", "uv.lock", "pdm.lock"), "Gemfile": ("Gemfile.lock",)}
AGENT_FILES = r"(^|/)(CLAUDE|AGENTS|GEMINI)\.md$|(^|/)\.cursorrules$|(^|/)\.cursor/rules/|(^|/)\.github/copilot-instructions\.md$"
REASONS = ("test", "doc", "vendored", "generated", "sample", "migration", "release", "gone")
PLACEHOLDER = r"(?i)^(x{3,}|\*{3,}|\.{3,}|changeme|change[-_ ]me|your[-_ ].*|example.*|placeholder|dummy|test(ing)?|secret|password|none|null|todo|<.*>|\$\{.*\}|\{\{.*\}\}|%\(.*\)s)$"


def says_generated(text: Column | str, name: Column | str) -> Column:
    """A marker in the first lines of a file, or a build output's name."""
    head = F.array_join(F.slice(F.split(text, "\n"), 1, GENERATED_LINES), "\n")
    name = F.col(name) if isinstance(name, str) else name
    return head.rlike(GENERATED) | name.rlike(GENERATED_NAME)


def interpreter(text: Column | str) -> Column:
    """The program of a `#!` line, without its folder, `env`, assignments and version."""
    line = F.regexp_extract(text, r"\A#!\s*([^\n]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(line, r"^\S*/env\s+(-\S+\s+)*", ""), r"^([A-Za-z_][A-Za-z0-9_]*=\S*\s+)+", "")
    program = F.regexp_replace(F.regexp_extract(rest, r"^(\S+)", 1), "^.*/", "")
    return F.nullif(F.regexp_replace(program, r"[\d.]+$", ""), F.lit(""))


def file_kinds(paths: DataFrame, vendored: DataFrame, generated: DataFrame, tree: DataFrame) -> DataFrame:
    """path, reasons, reason: why a path isn't ranked, in a fixed order; `reason` is the first."""
    kind = X.path_kinds("path")
    marked = (
        paths.select("path").distinct().join(vendored.select("path").distinct().withColumn("v", F.lit(True)), "path", "left")
        .join(generated.select("path").distinct().withColumn("g", F.lit(True)), "path", "left").join(tree.select("path").distinct().withColumn("t", F.lit(True)), "path", "left")
    )
    tests = (kind["test"], kind["doc"], F.col("v").isNotNull() | kind["vendor"], F.col("g").isNotNull(), kind["sample"], kind["migration"], F.col("path").rlike(r"(?i)(^|/)(version\.[a-z]+|_version\.py|changelog[^/]*)$"), F.col("t").isNull())
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(r)) for r, c in zip(REASONS, tests, strict=True)]))
    return marked.select("path", reasons.alias("reasons"), F.get(reasons, F.lit(0)).alias("reason"))


def coverage(kinds: DataFrame, sizes: DataFrame) -> DataFrame:
    """reason, files, lines: what is ranked (no reason) and what isn't."""
    return kinds.join(sizes, "path", "left").groupBy(F.coalesce("reason", F.lit("ranked")).alias("reason")).agg(F.count("*").alias("files"), F.sum(F.coalesce("code", F.lit(0))).alias("lines"))


def type_census(paths: DataFrame) -> DataFrame:
    """type, files: extensions, or whole names without one."""
    name = F.regexp_replace("path", "^.*/", "")
    kind = F.when(name.rlike(r"^.+\.[^.]+$"), F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))).otherwise(name)
    return paths.groupBy(kind.alias("type")).agg(F.count("*").alias("files"))


def binaries(files: DataFrame) -> DataFrame:
    """path, kind of files (path, content) whose first bytes are those of a program or archive."""
    head = F.lower(F.hex(F.substring("content", 1, 4)))
    kind = F.coalesce(*[F.when(F.startswith(head, F.lit(m)), F.lit(k)) for k, m in MAGIC])
    return files.select("path", kind.alias("kind")).where("kind IS NOT NULL")


def submodules(files: DataFrame) -> DataFrame:
    """name, url, problem of .gitmodules texts: plain transport, or credentials in the address."""
    part = files.select(F.explode(F.filter(F.split("text", r"(?m)^\s*\[submodule\s+"), lambda x: F.contains(x, F.lit("url")))).alias("s"))
    url = F.regexp_extract("s", r"(?m)^\s*url\s*=\s*(\S+)", 1)
    problem = F.when(url.rlike("^[a-z+]+://[^/@]*:[^/@]+@"), "credentials").when(url.rlike("^(http|git)://"), "plain transport").when(url.rlike(r"^(\.\./|/|file:)"), "local")
    return part.select(F.regexp_extract("s", r"""^["']([^"']+)""", 1).alias("name"), url.alias("url"), problem.alias("problem"))


def symlinks(links: DataFrame) -> DataFrame:
    """path, target, outside: links (path, target) whose target is absolute or climbs over the root."""
    parts = F.concat(F.filter(F.split(X.folder("path"), "/"), lambda x: x != ""), F.filter(F.split("target", "/"), lambda x: (x != "") & (x != ".")))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("now"), F.lit(0).alias("least")), lambda s, x: F.struct((s["now"] + F.when(x == "..", -1).otherwise(1)).alias("now"), F.least(s["least"], s["now"] + F.when(x == "..", -1).otherwise(1)).alias("least")))
    return links.select("path", "target", (F.startswith("target", F.lit("/")) | (depth["least"] < 0)).alias("outside"))


def presence(tree: DataFrame) -> DataFrame:
    """policy, present: conventional files."""
    flags = tree.agg(*[F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False)).alias(n) for n, p in POLICIES.items()])
    return flags.unpivot([], list(POLICIES), "policy", "present")


def owner_patterns(lines: DataFrame, tree: DataFrame) -> DataFrame:
    """pattern, matched: patterns of a CODEOWNERS file (line) and how many paths each matches."""
    pattern = F.regexp_extract("line", r"^\s*([^#\s]\S*)\s+\S", 1)
    anchored = F.contains(F.rtrim(pattern, F.lit("/")), F.lit("/"))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(pattern, "^/", ""), r"([.+()\[\]{}^$|])", r"\\$1"), r"\*\*/?", "\u0001"), r"\*", "[^/]*"), "\u0001", ".*")
    regex = F.concat(F.when(anchored, F.lit("^")).otherwise(F.lit("(^|.*/)")), F.regexp_replace(body, r"\?", "[^/]"), F.lit("(/.*)?$"))
    rules = lines.select(pattern.alias("pattern"), F.regexp_replace(regex, "/\\(/\\.\\*\\)\\?\\$$", "/.*\\$").alias("regex")).where("pattern <> ''").distinct()
    return rules.join(tree, F.expr("path RLIKE regex"), "left").groupBy("pattern").agg(F.count("path").alias("matched"))


def missing_updates(tree: DataFrame, updaters: DataFrame) -> DataFrame:
    """Ecosystems with manifests and no updater (ecosystem)."""
    flags = tree.agg(*[F.coalesce(F.bool_or(F.col("path").rlike(p)), F.lit(False)).alias(n) for n, p in ECOSYSTEM_FILES.items()])
    return flags.unpivot([], list(ECOSYSTEM_FILES), "ecosystem", "held").where("held").select("ecosystem").join(updaters.select("ecosystem"), "ecosystem", "left_anti")


def missing_locks(tree: DataFrame) -> DataFrame:
    """Manifests with no lock file beside or above them."""
    name = F.regexp_replace("path", "^.*/", "")
    manifests = tree.where(name.isin(*LOCKS)).select(F.col("path").alias("manifest"), name.alias("name"))
    parts = F.split(X.folder("manifest"), "/")
    above = manifests.select("manifest", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")))).alias("folder"))
    wanted = F.create_map(*[x for k, v in LOCKS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    asked = above.select("manifest", "folder", F.explode(F.element_at(wanted, F.col("name"))).alias("lock"))
    locks = tree.select(X.folder("path").alias("folder"), F.regexp_replace("path", "^.*/", "").alias("lock"))
    held = asked.join(locks, ["folder", "lock"], "left_semi").select("manifest").distinct()
    return manifests.select("manifest").join(held, "manifest", "left_anti")


def install_scripts(packages: DataFrame) -> DataFrame:
    """path, script, command: lifecycle scripts that run on install, of package.json texts."""
    scripts = F.from_json(F.get_json_object("text", "$.scripts"), "map<string,string>")
    return packages.select("path", F.explode(scripts).alias("script", "command")).where(F.col("script").isin("preinstall", "install", "postinstall", "prepare"))


def workflow_risks(flows: DataFrame) -> DataFrame:
    """path, risk: untrusted code run with a token, or an event's text put into a shell."""
    pwn = F.col("text").rlike(r"(?s)pull_request_target.*?uses:\s*actions/checkout.*?ref:\s*\$\{\{[^}]*pull_request\.head")
    shell = F.col("text").rlike(r"(?m)^\s*-?\s*run:(?:[^\n]*|[ \t]*[|>][-+]?[ \t]*\n(?:[ \t]+[^\n]*\n?)*?[^\n]*)\$\{\{\s*github\.event\.(issue|pull_request|comment|review|head_commit)[^}]*\.(title|body|message|ref|label)")
    return flows.select("path", F.explode(F.array_compact(F.array(F.when(pwn, "pwn request"), F.when(shell, "injection")))).alias("risk"))


def confusion(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """name, registry, host: scoped packages (name, registry) that a lock (name, url) takes from another host."""
    host = F.regexp_extract("url", r"^[a-z+]+://([^/:]+)", 1)
    return declared.join(locked, "name").select("name", "registry", host.alias("host")).where("registry <> host")


# licences --------------------------------------------------------------------------------------------


STRENGTHS = ("permissive", "weak copyleft", "strong copyleft")


def family(licence: str) -> int | None:
    """The place of a licence id in STRENGTHS; None for an id that isn't known."""
    name = re.sub(r"(-ONLY|-OR-LATER)$", "", licence.strip().upper().rstrip("+"))
    if name in PERMISSIVE or name.startswith("BSD-"):
        return 0
    return 1 if name.startswith(WEAK_COPYLEFT) else 2 if name.startswith(STRONG_COPYLEFT) else None


def strength(expression: str | None) -> str | None:
    """What an SPDX expression puts on its user, of STRENGTHS; null where no known id decides.

    OR binds least, then AND, then WITH. Of an AND, the most restrictive known
    term counts; of an OR the least restrictive, but an unknown branch hides
    all others than a permissive one; an exception makes strong weak.
    """
    text = (expression or "").strip()
    if "/" in text and " " not in text and not text.startswith("("):
        text = text.replace("/", " OR ")
    tokens = re.findall(r"\(|\)|[^\s()]+", text)[::-1]  # the next one last

    def comes(word: str) -> bool:
        if tokens and tokens[-1].upper() == word:
            tokens.pop()
            return True
        return False

    def atom() -> int | None:
        if not tokens:
            return None
        if comes("("):
            out = either()
            comes(")")
            return out
        out = family(tokens.pop())
        if comes("WITH"):
            if tokens:
                tokens.pop()
            out = 1 if out == 2 else out
        return out

    def several(part: Callable[[], int | None], word: str) -> list[int | None]:
        out = [part()]
        while comes(word):
            out.append(part())
        return out

    def both() -> int | None:
        return max((x for x in several(atom, "AND") if x is not None), default=None)

    def either() -> int | None:
        found = several(both, "OR")
        return 0 if 0 in found else None if None in found else min(found)

    out = either()
    return None if out is None else STRENGTHS[out]


def _strengths(x: pd.Series) -> pd.Series:
    return x.map(strength, na_action="ignore")


def licence_strength(expression: Column | str) -> Column:
    return F.pandas_udf(_strengths, "string")(expression)


def copyleft(packages: DataFrame) -> DataFrame:
    """strength, packages of (name, licence)."""
    distinct = packages.select("licence").distinct().withColumn("strength", licence_strength("licence"))
    return packages.join(distinct, "licence").groupBy("strength").agg(F.count("*").alias("packages"))


# secrets, agents ---------------------------------------------------------------------------------------


def is_placeholder(value: Column | str) -> Column:
    """Values that stand for a secret: masks, templates, words, one character repeated, runs of the alphabet or of digits."""
    value = F.col(value) if isinstance(value, str) else value
    low = F.lower(value)
    return value.rlike(PLACEHOLDER) | (F.size(F.array_distinct(F.split(low, "(?!^)"))) <= 2) | F.contains(F.lit("abcdefghijklmnopqrstuvwxyz0123456789"), low) | F.contains(F.lit("0123456789012345678901234567890"), low)


def keyed_digest(value: Column | str, key: bytes) -> Column:
    """HMAC-SHA256 of a text under a key, cut to 12 hex digits, by the definition: H(outer + H(inner + text))."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ pad for x in block).hex())) for pad in (0x36, 0x5C))
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))), 256), 1, 12)


def sanitised(rows: DataFrame, key: bytes) -> DataFrame:
    """Sightings with the value's keyed digest for the value: rule, file, commit, line, value, placeholder, confidence."""
    placeholder = is_placeholder("secret")
    weak = F.col("rule").startswith("generic") & F.col("secret").rlike(r"^[A-Za-z]+$")
    confidence = F.when(placeholder | weak, "low").when(F.col("rule").startswith("generic"), "medium").otherwise("high")
    return rows.select("rule", "file", "commit", "line", keyed_digest("secret", key).alias("value"), placeholder.alias("placeholder"), confidence.alias("confidence"))


def agent_files(tree: DataFrame) -> DataFrame:
    return tree.where(F.col("path").rlike(AGENT_FILES))


def agent_risks(files: DataFrame) -> DataFrame:
    """path, risk of agent settings (path, text as JSON): approval switched off, local settings tracked, literal values for servers."""
    off = F.lower(F.coalesce(F.get_json_object("text", "$.permissions.defaultMode"), F.lit(""))).isin("bypasspermissions", "dontask") | (F.get_json_object("text", "$.enableAllProjectMcpServers") == "true")
    servers = F.map_values(F.coalesce(F.from_json(F.get_json_object("text", "$.mcpServers"), "map<string,struct<env:map<string,string>>>"), F.create_map().cast("map<string,struct<env:map<string,string>>>")))
    literal = F.exists(servers, lambda s: F.exists(F.map_values(F.coalesce(s["env"], F.create_map().cast("map<string,string>"))), lambda v: (F.length(v) >= 12) & ~v.rlike(r"^\$")))
    local = F.col("path").rlike(r"(^|/)settings\.local\.json$")
    return files.select("path", F.explode(F.array_compact(F.array(F.when(off, "agent_approval_disabled"), F.when(local, "agent_local_settings"), F.when(literal, "mcp_literal_env")))).alias("risk"))


def control_coverage(facts: DataFrame) -> DataFrame:
    """control, result of one row of facts (booleans, null if not known): met, gap or unknown."""
    names = facts.columns
    told = facts.select(*[F.when(F.col(n).isNull(), "unknown").when(F.col(n), "met").otherwise("gap").alias(n) for n in names])
    return told.unpivot([], names, "control", "result")


def as_findings(df: DataFrame, rule: str, subject: str, severity: str = "info") -> DataFrame:
    """One finding a row of any of the tables above."""
    return finding(df, rule, severity, subject, *[c for c in df.columns if c != subject])
