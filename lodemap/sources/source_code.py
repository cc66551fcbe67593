"""Source files as relations: discovery, symbols, imports, calls and inheritance by line rules or Python's own parser."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import spread

#: Languages by file extension.
LANGUAGES = {"js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript", "ts": "typescript", "tsx": "typescript", "py": "python", "java": "java", "go": "go"}
#: Folders that discovery passes over.
IGNORED = ("node_modules", "dist", "build", "vendor", "coverage", "target", "__pycache__", "venv")
#: Line rules of a declaration: kind, pattern with the name as its last group, export mark.
_JS = (
    ("function", r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?function\s*\*?\s*([A-Za-z_$][\w$]*)"),
    ("class", r"^\s*(?:export\s+)?(?:default\s+)?(?:abstract\s+)?class\s+([A-Za-z_$][\w$]*)"),
    ("interface", r"^\s*(?:export\s+)?interface\s+([A-Za-z_$][\w$]*)"),
    ("type", r"^\s*(?:export\s+)?type\s+([A-Za-z_$][\w$]*)\s*[=<]"),
    ("enum", r"^\s*(?:export\s+)?(?:const\s+)?enum\s+([A-Za-z_$][\w$]*)"),
    ("function", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[A-Za-z_$][\w$]*)\s*=>"),
    ("const", r"^\s*(?:export\s+)?(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*[=:]"),
)
_PY = (("function", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)"), ("class", r"^\s*class\s+([A-Za-z_]\w*)"))
_JAVA = (
    ("class", r"^\s*(?:public\s+|abstract\s+|final\s+)*class\s+(\w+)"), ("interface", r"^\s*(?:public\s+)?interface\s+(\w+)"), ("enum", r"^\s*(?:public\s+)?enum\s+(\w+)"),
    ("function", r"^\s*(?:public|protected|private)\s+(?:static\s+|final\s+)*[\w<>\[\], ]+?\s(\w+)\s*\([^;]*$"),
)
_GO = (("function", r"^func\s+(?:\([^)]*\)\s*)?(\w+)\s*\("), ("class", r"^type\s+(\w+)\s+struct"), ("interface", r"^type\s+(\w+)\s+interface"), ("type", r"^type\s+(\w+)\s+\w+\s*$"))
#: Words before a parenthesis that call nothing.
NOT_CALLS = ("if", "for", "while", "switch", "catch", "function", "return", "typeof", "new", "await", "super", "def", "class", "with", "elif", "except", "print", "import")


def discover(spark: SparkSession, root: str, languages: list[str] | None = None) -> DataFrame:
    """path (from ``root``), text, language of the source files under ``root``; dot entries, ignored folders and empty files are passed over."""
    base = re.sub(r"^[a-z]+:/+", "/", root).strip("/")
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), "^/" + re.escape(base) + "/", "")
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    kinds = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    hidden = F.exists(F.split(rel, "/"), lambda p: p.startswith(".") | p.isin(*IGNORED))
    out = raw.select(rel.alias("path"), F.decode("content", "UTF-8").alias("text"), kinds[ext].alias("language"), (~hidden).alias("_kept")).where("_kept and language is not null").drop("_kept")
    return out.where(F.col("language").isin(languages)) if languages else out


def _lines(files: DataFrame) -> DataFrame:
    return files.select("path", "language", F.posexplode(F.split("text", "\r?\n")).alias("line", "body")).withColumn("line", F.col("line") + 1)


def _rules() -> dict[str, tuple]:
    return {"javascript": _JS, "typescript": _JS, "python": _PY, "java": _JAVA, "go": _GO}


def symbols(files: DataFrame) -> DataFrame:
    """path, line, kind, name, exported of each declaring line (the first rule that fits wins)."""
    lines = _lines(files)
    first: Column | None = None
    for language, rules in _rules().items():
        for kind, pattern in rules:
            name = F.regexp_extract("body", pattern, 1)
            hit = (F.col("language") == language) & (name != "")
            made = F.struct(F.lit(kind).alias("kind"), name.alias("name"))
            first = F.when(hit, made) if first is None else first.when(hit, made)
    found = lines.withColumn("s", first).where("s is not null").select("path", "line", "language", "body", "s.kind", "s.name")
    component = (F.col("kind").isin("function", "const")) & F.col("name").rlike("^[A-Z]") & F.col("language").isin("javascript", "typescript") & (F.col("kind") == "function")
    exported = (
        F.when(F.col("language") == "python", ~F.col("name").startswith("_"))
        .when(F.col("language") == "go", F.col("name").rlike("^[A-Z]"))
        .when(F.col("language") == "java", (F.col("kind") != "function") | F.col("body").rlike(r"\bpublic\b"))
        .otherwise(F.col("body").rlike(r"^\s*export\b"))
    )
    return found.select("path", "line", F.when(component, "component").otherwise(F.col("kind")).alias("kind"), "name", exported.alias("exported"))


def imports(files: DataFrame) -> DataFrame:
    """path, line, target, import_type (named, default, namespace, dynamic, require)."""
    lines = _lines(files)
    b = F.col("body")
    js = F.col("language").isin("javascript", "typescript")
    quoted = r"['\"]([^'\"]+)['\"]"
    rules = [
        (js, rf"^\s*(?:import|export)\s+(?:type\s+)?\{{[^}}]*\}}\s+from\s+{quoted}", "named"),
        (js, rf"^\s*(?:import|export)\s+\*\s*(?:as\s+\w+\s+)?from\s+{quoted}", "namespace"),
        (js, rf"^\s*import\s+[\w$]+(?:\s*,\s*\{{[^}}]*\}})?\s+from\s+{quoted}", "default"),
        (js, rf"^\s*import\s+{quoted}", "default"),
        (js, rf"\bimport\(\s*{quoted}\s*\)", "dynamic"),
        (js, rf"\brequire\(\s*{quoted}\s*\)", "require"),
        (F.col("language") == "python", r"^\s*from\s+([\w.]+)\s+import\b", "named"),
        (F.col("language") == "python", r"^\s*import\s+([\w.]+)", "namespace"),
        (F.col("language") == "java", r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;", "named"),
        (F.col("language") == "go", r"^\s*(?:import\s+)?(?:[\w.]+\s+)?\"([\w./-]+)\"\s*$", "named"),
    ]
    first: Column | None = None
    for on, pattern, kind in rules:
        target = F.regexp_extract(b, pattern, 1)
        made = F.struct(target.alias("target"), F.lit(kind).alias("import_type"))
        hit = on & (target != "")
        first = F.when(hit, made) if first is None else first.when(hit, made)
    return lines.withColumn("i", first).where("i is not null").select("path", "line", "i.target", "i.import_type")


def resolve_imports(found: DataFrame, files: DataFrame) -> DataFrame:
    """source_file, target_file, target: relative imports to the first existing candidate (as is, by extension, as an index)."""
    folder = F.regexp_replace("path", "/?[^/]*$", "")
    joined = F.concat_ws("/", F.when(folder != "", folder), F.regexp_replace("target", r"^\./", ""))
    base = spread(found.where(F.col("target").startswith(".")).select("path", "target")).select("path", "target", joined.alias("base"))
    for _ in range(8):  # a/../ collapses
        base = base.withColumn("base", F.regexp_replace("base", r"(^|/)(?!\.\.(?:/|$))[^/]+/\.\.(?=/|$)", "")).withColumn("base", F.regexp_replace("base", "^/", ""))
    tails = ["", *[f".{e}" for e in LANGUAGES], *[f"/index.{e}" for e in LANGUAGES]]
    tries = base.select("path", "target", F.posexplode(F.array(*[F.concat("base", F.lit(t)) for t in tails])).alias("rank", "candidate"))
    # a planner sizes the tries by the file they are read from, before they are multiplied, and would send them all through the driver
    hit = tries.hint("merge").join(files.select(F.col("path").alias("candidate")).distinct(), "candidate")
    return hit.groupBy(F.col("path").alias("source_file"), "target").agg(F.min_by("candidate", "rank").alias("target_file"))


def hierarchy(files: DataFrame) -> DataFrame:
    """path, child, relation, parent: one row per class line that extends or implements (the first parent)."""
    pattern = r"\b(?:class|interface)\s+(\w+)(?:<[^>]*>)?\s+(extends|implements)\s+([\w.]+)"
    py = r"^\s*class\s+(\w+)\(\s*([\w.]+)"
    lines = _lines(files)
    a, b = (F.regexp_extract("body", pattern, 1), F.regexp_extract("body", py, 1))
    child = F.when((F.col("language") == "python") & (b != ""), b).when(a != "", a)
    parent = F.when(F.col("language") == "python", F.regexp_extract("body", py, 2)).otherwise(F.regexp_extract("body", pattern, 3))
    relation = F.when(F.col("language") == "python", "extends").otherwise(F.regexp_extract("body", pattern, 2))
    return lines.select("path", child.alias("child"), relation.alias("relation"), parent.alias("parent")).where("child is not null")


def calls(files: DataFrame, declared: DataFrame) -> DataFrame:
    """path, caller, callee, line: names before a parenthesis inside the lines of each function.

    A function's lines run from its declaration to the line before the next declaration of its file.
    """
    from pyspark.sql import Window

    after = F.lead("line").over(Window.partitionBy("path").orderBy("line"))
    spans = declared.withColumn("until", F.coalesce(after - 1, F.lit(2**31 - 1))).where("kind in ('function', 'component')")
    spans = spans.select("path", F.col("name").alias("caller"), F.col("line").alias("since"), "until")
    body = _lines(files).select("path", "line", F.explode(F.regexp_extract_all("body", F.lit(r"(?<![.\w])(\w+)\s*\("), F.lit(1))).alias("callee"))
    body = body.where(~F.col("callee").isin(*NOT_CALLS))
    hit = body.join(spans, "path").where("line between since and until and callee <> caller")
    return hit.select("path", "caller", "callee", "line").distinct()


def python_symbols(files: DataFrame) -> DataFrame:
    """path, line, end_line, kind, name, exported, signature of Python sources, by the language's parser; broken ones give nothing."""

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"], strict=True):
                try:
                    tree = ast.parse(text or "")
                except (SyntaxError, ValueError):
                    continue
                for node in ast.walk(tree):
                    if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
                        cls = isinstance(node, ast.ClassDef)
                        sign = "" if cls else f"({ast.unparse(node.args)})" + (f" -> {ast.unparse(node.returns)}" if node.returns else "")
                        rows.append((path, node.lineno, node.end_lineno, "class" if cls else "function", node.name, not node.name.startswith("_"), sign if len(sign) <= 200 else sign[:200] + "..."))
            yield pd.DataFrame(rows, columns=["path", "line", "end_line", "kind", "name", "exported", "signature"])

    return files.where("language = 'python'").select("path", "text").mapInPandas(parse, "path string, line int, end_line int, kind string, name string, exported boolean, signature string")


def classify(files: DataFrame) -> DataFrame:
    """Add is_test and is_config by path."""
    test = r"(?i)(^|/)(tests?|__tests__|spec)/|\.(test|spec)\.[a-z]+$|(^|/)test_[^/]+\.py$|_test\.(py|go)$"
    config = r"(?i)(^|/)(package\.json|tsconfig[^/]*\.json|\.eslintrc[^/]*|[^/]*\.config\.[a-z]+|setup\.py|pyproject\.toml)$"
    return files.withColumn("is_test", F.col("path").rlike(test)).withColumn("is_config", F.col("path").rlike(config))


def assign_modules(files: DataFrame, modules: DataFrame) -> DataFrame:
    """path, module: the module of the longest root (name, root_path) above the file, else <root>; an equi-join on ancestors."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    hit = files.select("path", F.explode(above).alias("root_path")).join(modules.select("name", "root_path"), "root_path")
    best = hit.groupBy("path").agg(F.max_by("name", F.length("root_path")).alias("module"))
    return files.select("path").join(best, "path", "left").select("path", F.coalesce("module", F.lit("<root>")).alias("module"))
