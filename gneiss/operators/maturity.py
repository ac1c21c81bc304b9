"""How mature a repository is: checks that pass, pass by half, or fail, and the score and grade that follow.

One pass over the files gives, for each repository, which signals any of its files shows; the checks read those few flags.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Check:
    """A signal in the paths or texts of files; missing is what its absence counts as. Ids are fixed values."""

    name: str
    category: str
    missing: str
    path: str = ""
    text: str = ""


#: Lists of dependencies, whose text tells what a repository uses.
_LISTS = r"(^|/)(requirements[\w.-]*\.txt|pyproject\.toml|package\.json|Pipfile|go\.mod)$"
CHECKS = (
    Check("MAT-TEST-01", "testing", "fail", text=r"\bimport (unittest|pytest)\b|\bfrom unittest\b|\"testing\"|org\.junit|\bdescribe\("),
    Check("MAT-TEST-02", "testing", "fail", path=r"(^|/)tests?/|(^|/)test_[^/]*\.py$|_test\.(py|go)$|\.(test|spec)\.[jt]s$"),
    Check("MAT-TEST-03", "testing", "warn", text=r"pytest-cov|\bcoverage\b|\bnyc\b|jacoco"),
    Check("MAT-CI-01", "cicd", "fail", path=r"(^|/)\.github/workflows/[^/]*\.ya?ml$|(^|/)\.gitlab-ci\.yml$|(^|/)Jenkinsfile$"),
    Check("MAT-CI-02", "cicd", "warn", path=r"(^|/)(Dockerfile|Containerfile)$"),
    Check("MAT-CI-03", "cicd", "warn", path=r"(^|/)(Makefile|justfile|Taskfile\.ya?ml)$"),
    Check("MAT-MON-01", "monitoring", "fail", path=r"(^|/)(logging\.conf|log_config\.ya?ml)$", text=r"\blogging\.(basicConfig|getLogger|config)|\bloguru\b|\bstructlog\b|\blogger\.\w+\("),
    Check("MAT-MON-02", "monitoring", "warn", text=r"(?i)\bsentry"),
    Check("MAT-MON-03", "monitoring", "fail", text=r"[\"']/(health|healthz|ready|ping)[\"']|\bdef (health|healthz|health_check|ready|liveness)\b"),
    Check("MAT-CFG-01", "config", "fail", path=r"(^|/)[^/]*\.env(\.\w+)?$", text=r"\bload_dotenv\b|\bdotenv\b"),
    Check("MAT-CFG-02", "config", "warn", path=r"\.env\.(example|template|sample)$"),
    Check("MAT-ERR-01", "error_handling", "fail", text=r"exception_handler|errorhandler|register_error_handler|process_exception|@ControllerAdvice|\bcatch\s*\(|^\s*except\b"),
    Check("MAT-DEP-01", "deps", "fail", path=_LISTS),
    Check("MAT-DEP-02", "deps", "warn", path=r"(^|/)(Pipfile\.lock|poetry\.lock|package-lock\.json|yarn\.lock|go\.sum)$|lock\.json$"),
    Check("MAT-QLY-01", "quality", "warn", path=r"(^|/)(mypy\.ini|tsconfig\.json)$", text=r"\bmypy\b"),
    Check("MAT-QLY-02", "quality", "warn", path=r"(^|/)(\.prettierrc\w*|ruff\.toml)$", text=r"\b(ruff|black|gofmt|prettier)\b"),
    Check("MAT-QLY-03", "quality", "warn", path=r"(^|/)\.pre-commit-config\.yaml$"),
    Check("MAT-DOC-02", "docs", "warn", path=r"(?i)(^|/)(openapi|swagger)\.(json|ya?ml)$", text=r"docs_url|FastAPI\("),
)
#: Text that gives a secret away, and what a list of ignored files should name.
_SECRET = r"(?i)(api_key|api_secret|password|secret|token)\s*[:=]\s*[\"']\w{10,}"
README = r"(?i)(^|/)readme\.(md|txt|rst)$"


def _any(test: Column) -> Column:
    return F.max(F.coalesce(test, F.lit(False)).cast("int"))


def checks(files: DataFrame, least: int = 500) -> DataFrame:
    """(repo, name, category, status): every check of every repository. files: one row per file.

    A README passes from `least` characters and counts by half below; a list of ignored files counts by half unless it names
    settings and caches; text that gives a secret away fails."""
    path, text = F.coalesce("file_path", F.lit("")), F.coalesce("raw_content", F.lit(""))
    flags = []
    for i, c in enumerate(CHECKS):
        tests = ([path.rlike(c.path)] if c.path else []) + ([text.rlike("(?m)" + c.text)] if c.text else [])
        flags.append(_any(tests[0] | tests[1] if len(tests) > 1 else tests[0]).alias(f"c{i}"))
    ignored = path.rlike(r"(^|/)\.gitignore$")
    flags += [
        _any(text.rlike(_SECRET)).alias("secret"), _any(ignored).alias("ignored"), _any(ignored & text.contains(".env") & text.contains("__pycache__")).alias("ignored_well"),
        _any(path.rlike(README)).alias("readme"), F.max(F.when(path.rlike(README), F.length(text)).otherwise(0)).alias("readme_size"),
    ]
    by = files.groupBy("repo").agg(*flags)
    row = lambda name, category, status: F.struct(F.lit(name).alias("name"), F.lit(category).alias("category"), status.alias("status"))
    rows = [row(c.name, c.category, F.when(F.col(f"c{i}") == 1, "pass").otherwise(c.missing)) for i, c in enumerate(CHECKS)]
    rows += [
        row("MAT-CFG-03", "config", F.when(F.col("secret") == 1, "fail").otherwise("pass")),
        row("MAT-CFG-04", "config", F.when(F.col("ignored_well") == 1, "pass").when(F.col("ignored") == 1, "warn").otherwise("fail")),
        row("MAT-DOC-01", "docs", F.when(F.col("readme_size") > least, "pass").when(F.col("readme") == 1, "warn").otherwise("fail")),
    ]
    return by.select("repo", F.explode(F.array(*rows)).alias("r")).select("repo", "r.*")


def scores(found: DataFrame) -> DataFrame:
    """(repo, n_passed, n_half, n_failed, score, grade): half marks for warnings; A from 90, B from 75, C from 60, D from 40."""
    n = lambda s: F.sum((F.col("status") == s).cast("int"))
    by = found.groupBy("repo").agg(n("pass").alias("n_passed"), n("warn").alias("n_half"), n("fail").alias("n_failed"), F.count("*").alias("n_"))
    score = F.floor((F.col("n_passed") * 2 + F.col("n_half")) * 50 / F.col("n_")).cast("int")
    by = by.withColumn("score", score)
    return by.select("repo", "n_passed", "n_half", "n_failed", "score", F.when(score >= 90, "A").when(score >= 75, "B").when(score >= 60, "C").when(score >= 40, "D").otherwise("F").alias("grade"))
