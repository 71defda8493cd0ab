"""Hourly rows for tests."""

from datetime import date, timedelta


def full_days(plant, first, n, value=lambda day, hour: float(day * 24 + hour)):
    """n complete days of a plant from `first` on."""
    start = date.fromisoformat(first)
    return [
        (plant, start + timedelta(days=k), h, value(k, h), value(k, h) * 2, value(k, h) * 3)
        for k in range(n)
        for h in range(24)
    ]
