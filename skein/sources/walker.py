"""Source trees and other inputs: file lists, languages, exclusions, profiles, index files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.scalars import escape, glob_regex

#: File name endings of the languages.
EXTENSIONS = {"py": "python", "pyi": "python", "ts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "jsx", "cs": "csharp", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "php": "php", "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "hpp": "cpp", "kt": "kotlin", "swift": "swift", "scala": "scala", "dart": "dart", "ex": "elixir", "exs": "elixir", "sh": "bash", "lua": "lua", "r": "r", "hs": "haskell", "proto": "protobuf", "graphql": "graphql", "gql": "graphql", "html": "html", "css": "css", "scss": "scss", "json": "json", "yml": "yaml", "yaml": "yaml", "xml": "xml", "sql": "sql", "md": "markdown", "toml": "toml"}
#: File names that tell the language by themselves.
NAMES = {"Dockerfile": "dockerfile", "Makefile": "makefile", "Rakefile": "ruby", "Gemfile": "ruby", "CMakeLists.txt": "cmake"}
#: Folders that hold no sources of a project, those of every project first, then those that a language adds.
EXCLUDED = (
    ".git", ".hg", ".svn", ".idea", ".vscode", ".DS_Store", "__MACOSX", "node_modules", ".cache", ".tmp", "tmp", "temp",
    "build", "cmake-build-debug", "cmake-build-release", ".cmake",
    "bin", "obj", "publish", "artifacts", "packages", ".vs", "TestResults",
    "vendor", "target", ".gradle", "out",
    ".next", ".nuxt", ".output", ".svelte-kit", "dist", ".turbo",
    "__pycache__", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".eggs",
    ".bundle", "log", ".build", "DerivedData",
    "bower_components", "coverage",
)
#: Endings by which a text search tells languages; anything else is unknown.
GREP_TAGS = {"cs": "csharp", "ts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "jsx", "py": "python", "rs": "rust", "java": "java", "go": "go", "rb": "ruby", "php": "php", "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "c": "c", "h": "c", "kt": "kotlin", "kts": "kotlin", "swift": "swift", "html": "html", "htm": "html", "css": "css", "json": "json", "sh": "bash", "bash": "bash", "yml": "yaml", "yaml": "yaml", "lua": "lua", "r": "r", "R": "r", "dart": "dart", "scala": "scala", "sc": "scala", "hs": "haskell", "ex": "elixir", "exs": "elixir", "md": "markdown", "markdown": "markdown", "xml": "xml", "proto": "protobuf"}


def _lookup(key: Column, values: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def language_of(path: Column | str) -> Column:
    """The language of a path: by its file name, else by its ending; null if unknown."""
    c = F.col(path) if isinstance(path, str) else path
    name = F.element_at(F.split(c, "/"), -1)
    ending = F.when(F.contains(name, F.lit(".")), F.lower(F.element_at(F.split(name, r"\."), -1)))
    return F.coalesce(_lookup(name, NAMES), _lookup(F.coalesce(ending, F.lit("")), EXTENSIONS))


def grep_tag(path: Column | str) -> Column:
    """The language by which a text search files a path: by what follows its last dot, ``unknown`` without a match."""
    c = F.col(path) if isinstance(path, str) else path
    return F.coalesce(_lookup(F.element_at(F.split(c, r"\."), -1), GREP_TAGS), F.lit("unknown"))


def kept(path: Column | str) -> Column:
    """Whether a path lies in no excluded or hidden folder."""
    c = F.col(path) if isinstance(path, str) else path
    folders = F.slice(F.split(c, "/"), 1, F.greatest(F.size(F.split(c, "/")) - 1, F.lit(0)))
    return ~F.exists(folders, lambda f: f.isin(*EXCLUDED) | F.startswith(f, F.lit(".")))


def ignored_by(path: Column | str, patterns: list[str], folder: str = "", so_far: Column | None = None) -> Column:
    """Whether the lines of an ignore file in a folder exclude a path; the last line that fits decides, ! takes back. ``so_far`` is what files above say."""
    c = F.col(path) if isinstance(path, str) else path
    out = F.lit(False) if so_far is None else so_far
    head = escape(folder.strip("/") + "/") if folder.strip("/") else ""
    for line in patterns:
        p = line.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.lstrip("!")
        rooted, p = p.startswith("/"), p.strip("/")
        rx = glob_regex(p if "/" in p or rooted else f"**/{p}").rstrip("$").removeprefix("^").removeprefix("(?:^|/)")
        out = F.when(c.rlike(f"^{head}{rx}(?:/.*)?$"), F.lit(not back)).otherwise(out)
    return out


def ignore_files(spark: SparkSession, root: str, depth: int = 50) -> list[tuple[str, list[str]]]:
    """(folder below the root, lines) of the ignore files of a tree, the upper ones first. Readers of tables pass over hidden files, so these are asked for by name, level by level."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(top).toUri().getPath().rstrip("/")
    out = []
    for k in range(depth):
        level = root.rstrip("/") + "/*" * k
        if not fs.globStatus(path(level)):
            break
        for found in fs.globStatus(path(level + "/.gitignore")) or []:
            stream = fs.open(found.getPath())
            try:
                text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            finally:
                stream.close()
            out.append((found.getPath().getParent().toUri().getPath()[len(base) + 1 :], text.split("\n")))
    return out


def walk(spark: SparkSession, root: str, ignore: list[str] | None = None, depth: int = 50) -> DataFrame:
    """path (below the root), language, content of every source file under a folder, up to so many folders deep. Ignore files in any folder hold below it, the nearest last; ``ignore`` are further lines for the root."""
    read = spark.read.option("recursiveFileLookup", True).option("wholetext", True)
    base = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    full = F.regexp_replace(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), r"^\w+:/*", "")
    below = F.substring(full, len(base) + 2, 1_000_000)
    ignored = ignored_by("path", ignore or [])
    for folder, lines in ignore_files(spark, root, depth):
        ignored = ignored_by("path", lines, folder, ignored)
    lang = language_of("path")
    rel = read.text(root).select(below.alias("path"), F.col("value").alias("content"))
    return rel.filter(kept("path") & ~ignored & lang.isNotNull() & (F.size(F.split("path", "/")) <= depth)).select("path", lang.alias("language"), "content")


def profile(files: DataFrame) -> DataFrame:
    """aspect, value, n of a file list (project, path): languages, package managers, test frameworks, entry points, monorepo and environment signs."""
    name = F.element_at(F.split("path", "/"), -1)
    managers = {"package.json": "npm", "yarn.lock": "yarn", "pnpm-lock.yaml": "pnpm", "Cargo.toml": "cargo", "go.mod": "go", "pom.xml": "maven", "build.gradle": "gradle", "requirements.txt": "pip", "pyproject.toml": "python", "Gemfile": "bundler", "composer.json": "composer"}
    aspects = F.array(
        F.struct(F.lit("language").alias("aspect"), language_of("path").alias("value")),
        F.struct(F.lit("manager").alias("aspect"), _lookup(name, managers).alias("value")),
        F.struct(F.lit("tests").alias("aspect"), F.when(F.col("path").rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|[._-](test|spec)\.\w+$|_test\.\w+$"), F.lit("tests")).alias("value")),
        F.struct(F.lit("entry").alias("aspect"), F.when(F.col("path").rlike(r"(^|/)(main|index|app|server|program|manage|Program|Main|App)\.\w+$"), name).alias("value")),
        F.struct(F.lit("monorepo").alias("aspect"), F.when(name.isin("lerna.json", "nx.json", "turbo.json", "pnpm-workspace.yaml"), name).alias("value")),
        F.struct(F.lit("environment").alias("aspect"), F.when(name.rlike(r"^(\.env.*|docker-compose.*|Dockerfile)$"), name).alias("value")),
    )
    return files.select("project", F.explode(aspects).alias("x")).select("project", "x.*").filter("value is not null").groupBy("project", "aspect", "value").agg(F.count("*").alias("n"))


def baseline(spark: SparkSession, path: str) -> DataFrame:
    """project, metric, value of a baseline file: a JSON list of objects with numbers."""
    raw = spark.read.option("multiLine", True).json(path)
    metrics = [c for c, t in raw.dtypes if c != "project" and t in ("bigint", "double")]
    pairs = F.create_map(*[x for m in metrics for x in (F.lit(m), F.col(m).cast("long"))])
    return raw.select("project", F.explode(pairs).alias("metric", "value")).filter("value is not null")
