"""Scalar functions over columns: names, paths, offsets, digests, redaction. All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NAME_BYTES = 512


def ascii_lower(text: Column) -> Column:
    """A-Z alone; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def terminal(name: Column) -> Column:
    """What follows the last dot."""
    return F.split_part(name, F.lit("."), F.lit(-1))


def root(name: Column) -> Column:
    """What precedes the first dot or bracket."""
    return F.get(F.split(name, r"[.\[]"), F.lit(0))


def corresponds(value: Column, other: Column) -> Column:
    """Equal, or one is a member of the other: `a`, `a.b`, `a[0]`."""
    def member(x: Column, y: Column) -> Column:
        return F.startswith(x, F.concat(y, F.lit("."))) | F.startswith(x, F.concat(y, F.lit("[")))

    return (value == other) | member(value, other) | member(other, value)


def file_name(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(-1))


def extension(path: Column) -> Column:
    """ASCII-lower-cased, of the whole path; null without a dot."""
    return F.when(F.contains(path, F.lit(".")), ascii_lower(F.split_part(path, F.lit("."), F.lit(-1))))


def compact(name: Column) -> Column:
    return F.translate(ascii_lower(F.coalesce(name, F.lit(""))), "-_.:", "")


def bounded_name(name: Column) -> Column:
    """Null beyond NAME_BYTES bytes or when blank."""
    trimmed = F.trim(name)
    return F.when((F.octet_length(trimmed) <= NAME_BYTES) & (trimmed != ""), trimmed)


def truncated_name(name: Column) -> Column:
    """The longest prefix of whole characters within NAME_BYTES bytes."""
    # A cut inside a character leaves bytes that are no text; at most three bytes fewer are.
    cuts = [F.try_validate_utf8(F.substring(F.encode(name, "UTF-8"), 1, NAME_BYTES - k).cast("string")) for k in range(4)]
    return F.when(F.octet_length(name) <= NAME_BYTES, name).otherwise(F.coalesce(*cuts))


def normalize_path(path: Column) -> Column:
    """Without empty and `.` parts, `..` resolved; null if the path climbs above its top or is absolute."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    none = F.lit(None).cast("array<string>")
    walked = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda done, p: F.when(done.isNull(), none).when(p == "..", F.when(F.size(done) > 0, F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(none)).otherwise(F.concat(done, F.array(p))),
    )
    return F.when(~F.startswith(path, F.lit("/")), F.array_join(walked, "/"))


def safe_path(path: Column) -> Column:
    """The path itself unless it has a backslash, a control character, a drive letter or a part that climbs."""
    bad = path.rlike(r"[\\\x00-\x1f\x7f]|^[A-Za-z]:|(^|/)\.\.(/|$)|^/")
    return F.when(~bad, path)


def percent_encoded(path: Column) -> Column:
    """UTF-8 bytes other than letters, digits, `-._~/` as %XX."""
    return F.array_join(
        F.transform(F.split(path, "(?<=.)(?=.)"), lambda c: F.when(c.rlike("^[A-Za-z0-9._~/-]$"), c).otherwise(F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1"))), ""
    )


def byte_offset(text: Column, needle: Column | str) -> Column:
    """Of the first occurrence, in bytes from 0; null without one."""
    at = F.position(F.lit(needle) if isinstance(needle, str) else needle, text)
    return F.when(at > 0, F.octet_length(F.substring(text, F.lit(1), at - 1)).cast("long"))


def line_of(text: Column, at: Column) -> Column:
    """The line, from 1, of the character at place `at` (from 1)."""
    return (F.length(F.regexp_replace(F.substring(text, F.lit(1), at - 1), "[^\n]", "")) + 1).cast("int")


def column_of(text: Column, at: Column) -> Column:
    """The column, from 1, in characters."""
    return (F.length(F.substring_index(F.concat(F.lit("\n"), F.substring(text, F.lit(1), at - 1)), "\n", -1)) + 1).cast("int")


def digest(*parts: Column, prefix: str = "", size: int = 24) -> Column:
    """A content identifier: SHA-256 over length-prefixed fields, its first hexadecimal digits behind a prefix."""
    fields = [F.coalesce(F.concat(F.octet_length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat(*fields), 256), 1, size))


#: How severities read in exchange documents.
LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "informational": "note"}
SCORES = {"critical": "9.5", "high": "8.0", "medium": "5.5", "low": "3.0", "informational": "0.0"}


def mapped(column: Column, table: dict, default=None) -> Column:
    out = None
    for key, value in table.items():
        out = F.when(column == key, F.lit(value)) if out is None else out.when(column == key, F.lit(value))
    return out.otherwise(F.lit(default)) if default is not None else out


def severity_level(severity: Column) -> Column:
    return mapped(severity, LEVELS, "none")


def severity_score(severity: Column) -> Column:
    return mapped(severity, SCORES, "0.0")


#: Words that hide what they are: a key and its value, long mixed tokens, addresses; and the words whose next word is hidden.
SECRET = r"(?i)^(?:[a-z_-]*(?:password|passwd|secret|token|api_?key|credential)[a-z_-]*[=:].+|AKIA[0-9A-Z]{16}.*|gh[pousr]_[A-Za-z0-9]{20,}.*|sk-[A-Za-z0-9-]{16,}.*|[^@\s]+@[^@\s]+\.[a-z]{2,}[.,;]?)$"
CARRIES = r"(?i)^(?:bearer|password:|token:|secret:)$"
HIDDEN = "[REDACTED]"


#: What a lower-cased text with a hidden word has for sure; texts without any of these are not taken word by word.
HINTS = ["passw", "secret", "token", "apikey", "api_key", "credential", "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "sk-", "@", "bearer"]


def redacted(text: Column) -> Column:
    """struct(text, hidden): words by white space, joined by one space, secrets hidden and counted."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    before = F.concat(F.array(F.lit("")), F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))))  # not by index: that would split the text anew for each word
    slow = F.zip_with(words, before, lambda w, b: F.when(w.isNotNull(), F.when(w.rlike(SECRET) | b.rlike(CARRIES), F.lit(HIDDEN)).otherwise(w)))
    low, hint = F.lower(text), F.lit(False)
    for part in HINTS:
        hint = hint | F.contains(low, F.lit(part))
    joined = F.when(hint, F.array_join(slow, " ")).otherwise(F.trim(F.regexp_replace(text, r"\s+", " ")))
    count = F.when(F.contains(joined, F.lit(HIDDEN)), F.regexp_count(joined, F.lit(r"(?<![^ ])\[REDACTED\](?![^ ])"))).otherwise(0)
    return F.struct(joined.alias("text"), count.cast("long").alias("hidden"))


def cost_bound(input_tokens: Column, output_tokens: Column, input_micros: int, output_micros: int) -> Column:
    """Integer micro-units, rounded up by the thousand tokens."""
    def part(tokens: Column, price: int) -> Column:
        return F.floor((tokens.cast("long") * price + 999) / 1000).cast("long")

    return part(input_tokens, input_micros) + part(output_tokens, output_micros)


def display_name(name: Column) -> Column:
    """Without control characters, 256 characters at most."""
    return F.substring(F.regexp_replace(name, r"[\x00-\x1f\x7f]", ""), 1, 256)


#: What identifiers and origins look like.
FINGERPRINT, SCAN_ID = "^[0-9a-f]{64}$", "^scan_[0-9a-f]{24}$"
ORIGIN = r"(?i)^https?://(?:\[[^\]/?#@\s]+\]|[^\[:/?#@\s][^:/?#@\s]*)(?::[0-9]+)?$"


def is_fingerprint(text: Column) -> Column:
    return F.coalesce(text.rlike(FINGERPRINT), F.lit(False))


def is_scan_id(text: Column) -> Column:
    return F.coalesce(text.rlike(SCAN_ID), F.lit(False))


def is_origin(text: Column) -> Column:
    """A literal that names an origin: scheme, host, perhaps a port, and nothing behind."""
    return F.coalesce(text.rlike(ORIGIN), F.lit(False))


def appended(identity: Column, part: Column) -> Column:
    """A member of a value: both joined by a dot, either alone if the other is empty."""
    return F.when(F.coalesce(identity, F.lit("")) == "", F.coalesce(part, F.lit(""))).when(F.coalesce(part, F.lit("")) == "", identity).otherwise(F.concat_ws(".", identity, part))


def rfc3339(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def shell_option(shell: Column, option: Column) -> Column:
    """command (the next word is program text), leading (may stand before it), or null: short options that the shell knows, `c` once and no letter twice."""
    flags = F.substring(option, 2, 1 << 10)
    known = option.rlike("^-[cex]+$") | shell.isin("bash", "ksh", "zsh") & option.rlike("^-[cexl]+$")
    once = F.size(F.array_distinct(F.split(flags, ""))) == F.length(flags)
    return F.when(known & (F.length(F.regexp_replace(flags, "[^c]", "")) == 1) & once, "command").when(known & ~F.contains(flags, F.lit("c")), "leading")


def route_of(path: Column) -> Column:
    """The address that a route file serves: from behind its first `app` folder, without groups in parentheses; null for other files."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "app")
    kept = F.filter(F.slice(parts, F.greatest(at, F.lit(0)).cast("int") + 1, F.greatest(F.size(parts) - at.cast("int") - 1, F.lit(0))), lambda p: ~F.startswith(p, F.lit("(")))
    return F.when((at > 0) & F.element_at(parts, -1).rlike(r"^route\.[cm]?[jt]sx?$"), F.concat(F.lit("/"), F.array_join(kept, "/")))


def contract_path(path: Column) -> Column:
    """A path as contracts compare it: slashes only, no empty or `.` parts; null if absolute, empty or with any `..`."""
    plain = F.replace(path, F.lit("\\"), F.lit("/"))
    parts = F.filter(F.split(plain, "/"), lambda p: ~p.isin("", "."))
    fine = ~F.startswith(plain, F.lit("/")) & ~F.contains(plain, F.lit("\x00")) & ~F.array_contains(parts, "..") & (F.size(parts) > 0)
    return F.when(fine, F.array_join(parts, "/"))


def spans_equivalent(a: Column, b: Column, lines: int = 3) -> Column:
    """Structs (file, start_line, start_column, end_line, end_column) of one file that are equal, or one within the other and together of at most `lines` lines."""
    def starts(x: Column) -> Column:
        return F.struct(x.start_line, x.start_column)

    def ends(x: Column) -> Column:
        return F.struct(x.end_line, x.end_column)

    def within(outer: Column, inner: Column) -> Column:
        return (starts(outer) <= starts(inner)) & (ends(outer) >= ends(inner))

    near = F.greatest(a.end_line, b.end_line) - F.least(a.start_line, b.start_line) + 1 <= lines
    same = (starts(a) == starts(b)) & (ends(a) == ends(b)) & (a.file == b.file)
    return F.coalesce((contract_path(a.file) == contract_path(b.file)) & (same | (within(a, b) | within(b, a)) & near), F.lit(False))
