def area_under_pr(rows):
    """Trapezoids under precision by recall, over distinct scores, beginning at the first precision."""
    total = sum(y for _, y in rows)
    area, before_r, before_p = 0.0, 0.0, None
    for s in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(y for t, y in rows if t >= s)
        n = sum(1 for t, _ in rows if t >= s)
        r, p = tp / total, tp / n
        area += (r - before_r) * (p + (p if before_p is None else before_p)) / 2
        before_r, before_p = r, p
    return area
