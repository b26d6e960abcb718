"""Text measures, paths and edit classification."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def line_count(text: Column) -> Column:
    """Lines of a body whose trailing line feeds do not count; null and '' have none."""
    body = F.rtrim(F.coalesce(text, F.lit("")), F.lit("\n"))
    return F.when(body == "", F.lit(0)).otherwise(F.length(body) - F.length(F.replace(body, F.lit("\n"), F.lit(""))) + 1).cast("long")


def char_count(text: Column) -> Column:
    """Unicode scalars after trailing line feeds are trimmed."""
    return F.char_length(F.rtrim(F.coalesce(text, F.lit("")), F.lit("\n"))).cast("long")


def normalize_path(path: Column, folder: Column) -> Column:
    """Absolute paths stay; relative ones are put under the session's folder, if it has one."""
    folder = F.coalesce(folder, F.lit(""))
    return F.when(path.startswith("/") | (folder == ""), path).otherwise(F.concat(F.rtrim(folder, F.lit("/")), F.lit("/"), path))


def classify_edit(old: Column, new: Column, raw: Column | bool = False) -> Column:
    """'write' for an edit that replaces nothing by something, unless ``raw``; else 'edit'."""
    trimmed = [F.rtrim(F.coalesce(x, F.lit("")), F.lit("\n")) for x in (old, new)]
    raw = F.lit(raw) if isinstance(raw, bool) else raw
    return F.when(~raw & (trimmed[0] == "") & (trimmed[1] != ""), "write").otherwise("edit")


def repo_url(host: Column, repository: Column) -> Column:
    """'https://host/repository', or '' if either is missing."""
    host, repository = F.coalesce(host, F.lit("")), F.coalesce(repository, F.lit(""))
    return F.when((host != "") & (repository != ""), F.concat(F.lit("https://"), host, F.lit("/"), repository)).otherwise("")


def strip_numbered_lines(text: Column) -> Column:
    """Remove the prefixes 'N: ' that read tools put before the lines of a body, and an empty last line."""
    lines = F.transform(F.split(text, "\r?\n", -1), lambda x: F.regexp_replace(x, r"^\d+: ", ""))
    return F.array_join(F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines), "\n")


def read_body(output: Column) -> Column:
    """The file body in a read tool's output: between <content> tags, or the numbered lines after the blank line of
    'path, file, blank line, lines'; '' if it is neither."""
    inner = F.regexp_replace(F.substring_index(F.regexp_replace(output, r"(?s)^.*?<content>", ""), "</content>", 1), r"^\n", "")
    plain = F.regexp_extract(output, r"^[^\n]*\nfile\r?\n(?:[^\r\n]+\r?\n)*\r?\n(?:(?!\d+: )[^\n]*\n)*((?:\d+: [^\n]*(?:\n|$))+)", 1)
    return F.when(F.contains(output, F.lit("<content>")), strip_numbered_lines(inner)).otherwise(F.when(plain == "", "").otherwise(strip_numbered_lines(plain)))


def numbered_lines(text: Column) -> Column:
    """Of a text whose lines read 'N|line' the lines; lines of another shape go."""
    kept = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"^ *\d+\|"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"^ *\d+\|", "")), "\n")


#: What the lines of a command's status header begin with. Fixed values.
_HEADER = ["Chunk ID:", "Original token count:", "Process exited with code", "Script completed", "Wall time:"]


def strip_exec_header(output: Column) -> Column:
    """A command's output without the status header that ends in a line 'Output:'."""
    known = "|".join(h.replace(" ", r"\ ") for h in _HEADER)
    return F.regexp_replace(output, rf"^(?:(?:{known})[^\n]*\n)*Output:\n", "")


def trim_feeds(text: Column) -> Column:
    return F.rtrim(text, F.lit("\n"))


_SED = r"sed\s+-n\s+'[^']*'\s+(\S+)"
_CAT = r"(?m)^[^\S\n]*cat [^\S\n]*(\S+)"


def shell_kind(command: Column) -> Column:
    """What a shell command does to files: 'patch', 'sed' or 'cat', which read, or 'run'."""
    patch = F.contains(command, F.lit("*** Begin Patch"))
    return F.when(patch, "patch").when(command.rlike(_SED), "sed").when(command.rlike(_CAT), "cat").otherwise("run")


def shell_read_path(command: Column) -> Column:
    """The file that a reading shell command names, without quotes around it."""
    path = F.when(command.rlike(_SED), F.regexp_extract(command, _SED, 1)).otherwise(F.regexp_extract(command, _CAT, 1))
    return F.btrim(path, F.lit("\"'"))


def _marked(lines: Column, mark: str) -> Column:
    """What follows the mark in the lines that begin with it."""
    return trim_feeds(F.array_join(F.transform(F.filter(lines, lambda x: x.startswith(mark)), lambda x: F.substring(x, 2, 2**31 - 1)), "\n"))


def diff_parts(diff: Column) -> tuple[Column, Column]:
    """(old, new): the removed and the added lines of a diff."""
    lines = F.split(F.coalesce(diff, F.lit("")), "\r?\n", -1)
    return _marked(lines, "-"), _marked(lines, "+")


def patch_files(text: Column, moves: bool = False) -> Column:
    """The files of a patch envelope as structs of action ('add', 'update', 'delete'), file, old and new.

    An update that moves its file bears the new name if ``moves``. No envelope, no files.
    """
    header = r"\*\*\* (Update|Add|Delete) File:"
    inside = F.regexp_replace(text, r"(?s)^.*?\*\*\* Begin Patch", "")
    parts = F.split(F.split(inside, r"\n\*\*\* End Patch", 2)[0], rf"(?m)^(?={header})", -1)

    def one(part: Column) -> Column:
        old, new = diff_parts(part)
        action = F.lower(F.regexp_extract(part, rf"^{header}", 1))
        name = F.trim(F.regexp_extract(part, rf"^{header}([^\r\n]*)", 2))
        if moves:
            targets = F.regexp_extract_all(part, F.lit(r"(?m)^\*\*\* Move to:([^\r\n]*)"), F.lit(1))
            name = F.coalesce(F.trim(F.try_element_at(targets, F.lit(-1))), name)
        return F.struct(action.alias("action"), name.alias("file"), old.alias("old"), new.alias("new"))

    found = F.transform(F.filter(parts, lambda p: p.rlike(rf"^{header}")), one)
    return F.when(F.contains(text, F.lit("*** Begin Patch")), found).otherwise(F.expr("cast(array() as array<struct<action:string,file:string,old:string,new:string>>)"))
