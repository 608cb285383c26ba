"""Order-insensitive comparison of two result sets (row count, columns, values)."""

import hashlib
import math


def norm(v):
    if v is None:
        return "∅"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v)   # exact: money is summed in decimal
    if hasattr(v, "isoformat"):
        return str(v).replace("T", " ")
    return str(v)


def digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(norm(r[i]) for i in order) for r in rows)
    return hashlib.sha256("\n".join(lines).encode()).hexdigest(), lines
