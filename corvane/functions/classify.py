"""Classification of files by path and content, as column expressions over ordinary tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import ascii_lower, extension, file_name

# Directory names, extensions, manifest names and framework signatures that decide a file's class.
VENDOR = ["node_modules", "vendor", "vendors", "third_party", "third-party", ".venv", "venv", "site-packages"]
GENERATED = ["target", "dist", "build", "out", "coverage", ".next", ".nuxt", ".svelte-kit", ".turbo", ".cache", "__pycache__", ".pytest_cache", ".mypy_cache", ".ruff_cache", ".gradle"]
LANGUAGES = {
    "C": "c h", "C++": "cc cpp cxx hpp hh", "C#": "cs", "Dart": "dart", "Elixir": "ex exs", "Erlang": "erl hrl", "Go": "go", "Java": "java",
    "JavaScript": "js jsx mjs cjs", "Kotlin": "kt kts", "Lua": "lua", "PHP": "php", "Perl": "pl pm", "Python": "py pyi", "R": "r", "Ruby": "rb",
    "Rust": "rs", "Scala": "scala sc", "Shell": "sh bash zsh fish", "Swift": "swift", "TypeScript": "ts tsx mts cts", "Vue": "vue", "Svelte": "svelte",
}
MANIFESTS = {
    "cargo": "cargo.toml", "npm": "package.json", "pnpm-workspace": "pnpm-workspace.yaml", "deno": "deno.json deno.jsonc", "python": "pyproject.toml",
    "python-package": "setup.py setup.cfg", "python-requirements": "requirements.txt pipfile", "go-modules": "go.mod", "maven": "pom.xml",
    "gradle": "build.gradle build.gradle.kts settings.gradle settings.gradle.kts", "bundler": "gemfile", "composer": "composer.json",
    "swift-package": "package.swift", "mix": "mix.exs", "dart-pub": "pubspec.yaml", "dotnet": "directory.build.props directory.packages.props",
}
LOCKFILES = {
    "cargo-lock": "cargo.lock", "npm-lock": "package-lock.json npm-shrinkwrap.json", "pnpm-lock": "pnpm-lock.yaml", "yarn-lock": "yarn.lock",
    "bun-lock": "bun.lock bun.lockb", "python-lock": "pipfile.lock poetry.lock uv.lock", "go-checksums": "go.sum", "bundler-lock": "gemfile.lock",
    "composer-lock": "composer.lock", "swift-lock": "package.resolved", "mix-lock": "mix.lock", "dart-pub-lock": "pubspec.lock",
}
PROJECT_ENDINGS = (".csproj", ".fsproj", ".vbproj")
ENTRY_POINTS = {"main": "main.rs main.go main.py main.ts main.js main.kt main.java", "application": "app.py app.ts app.js app.rb", "server": "server.py server.ts server.js server.rb", "framework-cli": "manage.py"}
PARSERS = {"javascript": "js mjs cjs", "jsx": "jsx", "typescript": "ts mts cts", "tsx": "tsx", "rust": "rs", "python": "py pyi", "go": "go"}
FRAMEWORKS = {
    "Actix Web": "actix-web", "ASP.NET Core": "microsoft.aspnetcore", "Axum": "axum", "Django": "django", "Express": "express", "FastAPI": "fastapi",
    "Flask": "flask", "Gin": "gin-gonic/gin", "Go Chi": "go-chi/chi", "Echo": "labstack/echo", "NestJS": "@nestjs/core", "Next.js": '"next"',
    "Rails": "rails", "Rocket": "rocket", "Spring Boot": "spring-boot",
}
DOCUMENTATION, CONFIGURATION, DATA = "md mdx rst adoc txt", "json jsonc toml yaml yml ini conf cfg xml", "csv tsv sql graphql gql"
SAMPLE_BYTES, CONTROL_PERCENT = 8192, 10


def _in(column: Column, words: str) -> Column:
    return F.coalesce(column.isin(*words.split()), F.lit(False))


def _named(column: Column, table: dict[str, str]) -> Column:
    out = None
    for name, words in table.items():
        out = F.when(_in(column, words), name) if out is None else out.when(_in(column, words), name)
    return out


def _parts(path: Column) -> Column:
    return F.split(ascii_lower(path), "/")


def origin(path: Column) -> Column:
    """vendor if any part is a vendor directory; else generated if any is a build one; else project."""
    return F.when(F.exists(_parts(path), lambda p: p.isin(*VENDOR)), "vendor").when(F.exists(_parts(path), lambda p: p.isin(*GENERATED)), "generated").otherwise("project")


def language(path: Column) -> Column:
    return _named(extension(path), LANGUAGES)


def parser_mode(path: Column) -> Column:
    return _named(extension(path), PARSERS)


def manifest_kind(path: Column) -> Column:
    name = ascii_lower(file_name(path))
    projects = F.lit(False)
    for ending in PROJECT_ENDINGS:
        projects = projects | F.endswith(name, F.lit(ending))
    return F.coalesce(_named(name, MANIFESTS | LOCKFILES), F.when(projects, "dotnet-project"))


def is_lockfile(path: Column) -> Column:
    return _in(ascii_lower(file_name(path)), " ".join(LOCKFILES.values()))


def is_test(path: Column) -> Column:
    name = ascii_lower(file_name(path))
    return F.exists(_parts(path), lambda p: p.isin("test", "tests", "spec", "specs")) | name.rlike(r"\.(test|spec)\.|^test_|_test\.(rs|go)$")


def is_build_automation(path: Column) -> Column:
    lower = ascii_lower(path)
    return _in(file_name(lower), "dockerfile makefile justfile") | lower.rlike(r"^\.github/workflows/|^\.circleci/") | _in(lower, ".gitlab-ci.yml azure-pipelines.yml")


def is_configuration(path: Column) -> Column:
    name = ascii_lower(file_name(path))
    return F.startswith(name, F.lit(".env.")) | _in(name, ".env editorconfig") | _in(extension(path), CONFIGURATION)


def file_kind(path: Column, binary: Column | None = None) -> Column:
    known = language(path).isNotNull()
    out = F.when(binary if binary is not None else F.lit(False), "binary").when(is_lockfile(path), "lockfile").when(manifest_kind(path).isNotNull(), "manifest")
    out = out.when(is_test(path) & known, "test-source").when(known, "source").when(is_build_automation(path), "build-configuration")
    return out.when(_in(extension(path), DOCUMENTATION), "documentation").when(is_configuration(path), "configuration").when(_in(extension(path), DATA), "data").otherwise("other")


def entry_point(path: Column) -> Column:
    return _named(ascii_lower(file_name(path)), ENTRY_POINTS)


def control_percent(content: Column) -> Column:
    """Whole percent of control bytes (other than tab, line end, return, form feed) in the first SAMPLE_BYTES; content is binary."""
    sample = F.substring(content, 1, SAMPLE_BYTES)
    # Bytes as Latin-1 characters: one a byte.
    shown = F.decode(sample, "ISO-8859-1")
    controls = F.length(F.regexp_replace(shown, r"[^\x00-\x08\x0b\x0e-\x1f\x7f]", ""))
    return F.when(F.octet_length(sample) > 0, F.floor(controls * 100 / F.octet_length(sample))).otherwise(0).cast("long")


def is_binary(content: Column) -> Column:
    sample = F.substring(content, 1, SAMPLE_BYTES)
    return F.contains(F.decode(sample, "ISO-8859-1"), F.lit("\x00")) | (control_percent(content) > CONTROL_PERCENT)


def framework_offsets(content: Column, signatures: dict[str, str] = FRAMEWORKS) -> Column:
    """array of (name, first byte offset): plain substrings of the lower-cased text."""
    lower = ascii_lower(content)
    found = [F.when(F.instr(lower, needle) > 0, F.struct(F.lit(name).alias("name"), F.octet_length(F.substring_index(lower, needle, 1)).cast("long").alias("start_byte"))) for name, needle in signatures.items()]
    return F.array_compact(F.array(*found))
