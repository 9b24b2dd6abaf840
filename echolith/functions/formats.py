"""Values as text for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from echolith.functions.text import tokens


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def format_confidence(share: Column | str) -> Column:
    percent = F.round(_col(share) * 100).cast("int")
    label = F.when(percent >= 90, "High").when(percent >= 70, "Medium").otherwise("Low")
    return F.format_string("%s (%d%%)", label, percent)


def format_timestamp(ms: Column | str, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """UTC, if the session's zone is UTC."""
    return F.date_format(F.timestamp_millis(_col(ms)), pattern)


def format_optional_timestamp(ms: Column | str) -> Column:
    ms = _col(ms)
    return F.when(F.coalesce(ms, F.lit(0)) <= 0, "never").otherwise(format_timestamp(ms))


def format_duration(ms: Column | str) -> Column:
    ms = _col(ms)
    tenths = lambda x: F.format_string("%.1f", F.bround(x, 1))
    return (
        F.when(ms.isNull(), "—").when(ms < 1000, F.concat(ms.cast("string"), F.lit("ms")))
        .when(ms < 60_000, F.concat(tenths(ms / 1000), F.lit("s"))).otherwise(F.concat(tenths(ms / 60_000), F.lit("m")))
    )


def format_bytes(n: Column | str) -> Column:
    n = _col(n)
    return (
        F.when(n < 1024, F.format_string("%d B", n)).when(n < 1024**2, F.format_string("%.1f KB", n / 1024))
        .when(n < 1024**3, F.format_string("%.2f MB", n / 1024**2)).otherwise(F.format_string("%.2f GB", n / 1024**3))
    )


def fragmentation(free: Column | str, total: Column | str) -> Column:
    """Percent of a whole that is free; 0 of nothing."""
    free, total = _col(free), _col(total)
    return F.when(total > 0, free / total * 100).otherwise(0.0)


def csv_escape(text: Column | str) -> Column:
    text = _col(text)
    return F.when(F.rlike(text, F.lit('[,"\n]')), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def csv_line(command: str, cwd: str, exit_code: str, duration_ms: str, completed_at_ms: str, session_id: str) -> Column:
    """One line of the CSV export; nulls are empty."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws(",", csv_escape(command), csv_escape(cwd), plain(exit_code), plain(duration_ms), plain(completed_at_ms), csv_escape(session_id))


# Tools by their class.
TOOL_CLASSES = {
    "container": "docker docker-compose podman",
    "version control": "git gh",
    "rust": "cargo rustc rustup",
    "node": "npm npx yarn pnpm bun node deno",
    "python": "pip pip3 python python3 uv poetry conda",
    "go": "go",
    "files": "ls find tree du df stat file cat less head tail wc sort uniq cut awk sed grep rg fd bat exa eza cd pushd popd mkdir rmdir rm cp mv ln chmod chown touch",
    "system": "systemctl journalctl service sudo su doas",
    "network": "ssh scp rsync curl wget httpie",
    "build": "make cmake ninja meson gcc g++ clang cc",
    "editor": "vim nvim nano emacs code vi",
    "cluster": "kubectl k9s helm terraform ansible",
}


def tool_class(command: Column | str) -> Column:
    """The class of the first token's last path part; ``other`` if it has none."""
    base = F.element_at(F.split(F.coalesce(F.get(tokens(command), F.lit(0)), F.lit("")), "/"), -1)
    out = F.lit("other")
    for name, tools in TOOL_CLASSES.items():
        out = F.when(base.isin(tools.split()), name).otherwise(out)
    return out
