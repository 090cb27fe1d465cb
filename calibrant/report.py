"""Text reports of small results: what to run next, curves, summaries. The only place that collects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calibrant.sources.files import markdown_table


def curve_report(results: DataFrame, areas: DataFrame) -> str:
    """SRC-21: accuracies by label and budget, and the areas under them."""
    wide = results.groupBy("label").pivot("budget").agg(F.first("accuracy")).orderBy("label")
    return f"## Accuracy by budget\n\n{markdown_table(wide)}\n\n## Area\n\n{markdown_table(areas.orderBy('label'))}\n"


def scale_advice(hours_one: float | None, hours_two: float | None, long_share: float | None, limit_hours: float = 72.0) -> list[str]:
    """AGG-41: whether the length limit, the corpus size and one worker are enough."""
    out = []
    if long_share is not None:
        out.append(f"{long_share:.2f} of lengths are over 4096: " + ("few, the limit of 8192 can stay, the mean is far below it" if long_share < 0.05 else "a long tail, the limit of 8192 is right"))
    if hours_one is not None and hours_two is not None:
        if hours_one <= limit_hours:
            out.append(f"one worker takes {hours_one:.0f} h: enough")
        elif hours_two <= limit_hours:
            out.append(f"one worker takes {hours_one:.0f} h, two take {hours_two:.0f} h: use two")
        else:
            out.append(f"two workers take {hours_two:.0f} h: make the corpus smaller")
    out.append("start with 5,000 to 10,000 rows in the base pool and refresh the rest")
    return out
