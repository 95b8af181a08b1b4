"""Column builders shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the patterns by which subjects are read
FIX_TYPE = r"(?i)^(fix|hotfix|bugfix)(\([^)]*\))?!?:"
FIX_WORD = r"(?i)\b(fix|fixes|fixed|fixing|bugfix|hotfix|bug|bugs|regression|crash|crashes)\b"
CONVENTIONAL = r"^(build|chore|ci|docs|feat|fix|perf|refactor|revert|style|test)(\([^)]*\))?!?:"
TEST_PATH = (
    r"(?i)(^|/)(tests?|spec|specs|__tests__|testing|testsuite|snapshots?|__snapshots__|__fixtures__|smoke|e2e|[\w-]+[_-]tests?|tests?[_-][\w-]+)(/|$)"
    r"|(^|/)(test_[^/]*|[^/]*_test\.[^/]+|[^/]*\.spec\.[^/]+|[^/]*\.test\.[^/]+|[^/]*[-_.]e2e\.[^/]+|[^/]*\.snap)$"
)
TEST_SUFFIX = (
    r"[A-Za-z0-9]Tests?\.(java|kt|kts|scala|groovy|swift|cs)$|[A-Za-z0-9]Spec\.(hs|lhs|scala|kt|groovy)$|_spec\.rb$|\.t\.sol$"
    r"|(^|/)tb_[^/]*\.(v|sv|vhd|vhdl)$|_tb\.(v|sv|vhd|vhdl)$|(^|/)[A-Za-z0-9]+Tests/"
)
DOC_DIR = r"(?i)(^|/)docs?([-_][\w-]+)?(/|$)|(^|/)[A-Za-z0-9]+Docs/"
DOC_EXT = r"(?i)\.(md|markdown|rst|txt|adoc|pyi|d\.ts)$"
TXT_MANIFEST = r"(?i)(^|/)([^/]*requirements[^/]*|constraints[^/]*|cmakelists)\.txt$"
SAMPLE_PATH = r"(?i)(^|/)(examples?|samples?|fixtures?([-_][\w-]+)?|testdata|demos?|rules|stubs?|tutorials?|exercises?(files)?)(/|$)|\.stub$|(^|/)testdata[._-][^/]*$"
PACKAGE_EXAMPLE = r"(?i)(^|/)(com|org|net|io|dev|me|co)/examples?(/|$)"
VENDOR_PATH = r"(?i)(^|/)(_?vendor|vendored|node_modules|third_?party|external|deps|\.yarn|Godeps/_workspace)(/|$)"
MIGRATION_DIR = r"(?i)(^|/)((migrations?[\w-]*|db/migrate)/(versions/)?|alembic/versions/)[^/]+$"
MIGRATION_NAME = r"(?i)(^|/)(\d{3,}[_.-]|V\d+(_\d+)*__|[0-9a-f]{12}_)[^/]*$"
MOCK_PATH = r"(?i)(^|/)mocks?/|(^|/)mock_[^/]+$|(^|/)mock\.[a-z]+$|_mocks?\.[a-z]+$"
BOT_NAME = r"(?i)\bbot\b|\bci\b|deploy|automation|releaser|release-bot"
NO_REPLY = r"(?i)(?:do[-_.]?not[-_.]?reply|no[-_.]?reply)"
CREDENTIAL_NAME = r"(^|/)(\.env(\..+)?|\.netrc|_netrc|\.pypirc|\.dockercfg|id_(rsa|dsa|ecdsa|ed25519))$"
CREDENTIAL_TEMPLATE = r"(^|/)\.env\.(.+\.)?(example|sample|template|dist)$"
PLACEHOLDER_EMAIL = r"(@example\.(com|org|net)$|^you@|^user@|^root@|@localhost$)"


# what a text must hold for the patterns above to match: asked first, as those cost far more
FIX_PART = r"(?i)fix|bug|regression|crash"
TEST_PART = r"(?i)t(?:est|b_)|s(?:pec|nap|moke)|fixtures|e2e|\.t\.sol|_tb\."
REFERENCE_PART = r"(?i)fixe|close|refs|resolve"


def is_fix(subject: Column | str) -> Column:
    """A subject typed as a fix, or with a word for one."""
    subject = F.col(subject) if isinstance(subject, str) else subject
    return subject.rlike(FIX_PART) & (subject.rlike(FIX_TYPE) | subject.rlike(FIX_WORD))


def is_revert(subject: Column | str) -> Column:
    return (F.col(subject) if isinstance(subject, str) else subject).startswith("Revert ")


def ticket_key(subject: Column | str) -> Column:
    """`#123` of a suffix `(#123)`, else a leading `ABC-12`, else `#12` of a `fixes #12`; null without one."""
    subject = F.col(subject) if isinstance(subject, str) else subject
    number = lambda pattern, rough: F.when(rough, F.regexp_extract(subject, pattern, 1)).otherwise("")
    suffix, leading = number(r"\(#(\d+)\)\s*$", F.contains(subject, F.lit("(#"))), number(r"^\s*[\[(]?([A-Z][A-Z0-9]+-\d+)\b", F.contains(subject, F.lit("-")))
    reference = number(r"(?i)\b(?:fixes|fixed|closes|closed|refs|resolves|resolved)\s+#?(\d+)\b", subject.rlike(REFERENCE_PART))
    return F.when(suffix != "", F.concat(F.lit("#"), suffix)).when(leading != "", leading).when(reference != "", F.concat(F.lit("#"), reference))


def clauses(subject: Column | str) -> Column:
    """How many things a subject lists: its parts between ; , & and +, brackets and backticks left out; what follows an `and` counts with two words or more."""
    subject = F.col(subject) if isinstance(subject, str) else subject
    bare = F.regexp_replace(F.coalesce(subject, F.lit("")), r"\([^()]*\)|\[[^\[\]]*\]|`[^`]*`", "")

    def count(part: Column) -> Column:
        pieces = F.filter(F.split(part, r"(?i)\s+and\s+"), lambda x: F.trim(x) != "")
        rest = F.filter(F.slice(pieces, F.lit(2), F.size(pieces)), lambda x: F.size(F.split(F.trim(x), r"\s+")) >= 2)
        return F.when(F.size(pieces) > 0, 1 + F.size(rest)).otherwise(0)

    return F.aggregate(F.transform(F.split(bare, r"\s*[;,&+]\s*"), count), F.lit(0), lambda a, x: a + x)


def is_test_path(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(TEST_PART) & (path.rlike(TEST_PATH) | path.rlike(TEST_SUFFIX))


def is_doc_path(path: Column | str) -> Column:
    path = F.col(path) if isinstance(path, str) else path
    return path.rlike(DOC_DIR) | (path.rlike(DOC_EXT) & ~path.rlike(TXT_MANIFEST))


def path_kinds(path: Column | str) -> Column:
    """Struct of what a path's name says: test, doc, sample, vendor, mock, migration, credential."""
    path = F.col(path) if isinstance(path, str) else path
    return F.struct(
        is_test_path(path).alias("test"), is_doc_path(path).alias("doc"), (path.rlike(SAMPLE_PATH) & ~path.rlike(PACKAGE_EXAMPLE)).alias("sample"), path.rlike(VENDOR_PATH).alias("vendor"),
        path.rlike(MOCK_PATH).alias("mock"), (path.rlike(MIGRATION_DIR) & path.rlike(MIGRATION_NAME)).alias("migration"), (path.rlike(CREDENTIAL_NAME) & ~path.rlike(CREDENTIAL_TEMPLATE)).alias("credential"),
    )


def month_number(date: Column | str) -> Column:
    return F.year(date) * 12 + F.month(date)


def whole_months(earlier: Column, later: Column) -> Column:
    """Whole months between two dates, not below zero; a month is complete when the day of the month is reached again."""
    return F.greatest(F.lit(0), month_number(later) - month_number(earlier) - F.when(F.dayofmonth(later) < F.dayofmonth(earlier), 1).otherwise(0))


def half_up(x: Column) -> Column:
    return F.floor(x + F.lit(0.5)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    """a / b as a double; null where b is zero."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def area(path: Column | str, depth: int, base: int = 0) -> Column:
    """The directory prefix at a depth, or `(root files)` for files above it."""
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.when(F.size(folders) <= base, F.lit("(root files)")).otherwise(F.array_join(F.slice(folders, 1, base + depth), "/"))


def folder(path: Column | str) -> Column:
    """The directory of a path, empty for root files."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def apportioned(lines: Column, people: Column, position: Column) -> Column:
    """An equal integer share of lines; the remainder goes to the first positions, one each."""
    return F.floor(lines / people).cast("long") + F.when(position < lines % people, 1).otherwise(0)


def renamed_to(path: Column | str) -> Column:
    """The new path of `a => b` or `dir/{a => b}/c`."""
    path = F.col(path) if isinstance(path, str) else path
    braced = F.regexp_replace(F.regexp_replace(path, r"\{[^{}]*? => ([^{}]*)\}", "$1"), "//", "/")
    return F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), braced).otherwise(F.substring_index(path, " => ", -1))


def renamed_from(path: Column | str) -> Column:
    """The old path of a rename."""
    path = F.col(path) if isinstance(path, str) else path
    braced = F.regexp_replace(F.regexp_replace(F.regexp_replace(path, r"\{([^{}]*?) => [^{}]*\}", "$1"), "//", "/"), "^/", "")
    return F.when(path.rlike(r"\{[^{}]* => [^{}]*\}"), braced).otherwise(F.substring_index(path, " => ", 1))


def version_key(version: Column | str) -> Column:
    """All runs of digits of a version as numbers; arrays compare item by item."""
    return F.transform(F.regexp_extract_all(version, F.lit(r"(\d+)"), F.lit(1)), lambda x: F.try_to_number(x, F.lit("9" * 18)).cast("long"))


def wilson(successes: Column, n: Column, z: float = 1.96) -> Column:
    """Struct (low, high) of the Wilson score interval, within 0 and 1; null without trials."""
    p, zz = successes / n, F.lit(z * z)
    middle, half = p + zz / (2 * n), F.lit(z) * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    scale = 1 + zz / n
    return F.when(n > 0, F.struct(F.greatest(F.lit(0.0), (middle - half) / scale).alias("low"), F.least(F.lit(1.0), (middle + half) / scale).alias("high")))


def shannon(share: Column) -> Column:
    """The term of one share in an entropy in bits."""
    return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))
