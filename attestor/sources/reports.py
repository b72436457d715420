"""Sinks for small results: Markdown and LaTeX tables.  The caller passes a bounded table; more rows than ``most`` are an error."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _rows(df: DataFrame, most: int) -> list[list[str]]:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report holds at most {most} rows")
    return [["" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r] for r in rows]


def markdown(df: DataFrame, most: int = 1_000) -> str:
    """A Markdown table."""
    lines = [df.columns, ["---"] * len(df.columns), *_rows(df, most)]
    return "\n".join("| " + " | ".join(x.replace("|", "\\|") for x in line) + " |" for line in lines) + "\n"


def latex(df: DataFrame, most: int = 1_000) -> str:
    """A LaTeX tabular."""
    signs = {"&": r"\&", "%": r"\%", "_": r"\_", "#": r"\#", "$": r"\$"}
    clean = lambda x: "".join(signs.get(c, c) for c in x)
    body = [" & ".join(map(clean, line)) + r" \\" for line in [df.columns, *_rows(df, most)]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", *body, r"\end{tabular}", ""])
