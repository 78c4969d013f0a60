"""Brute force model of the duplicate rules, for small tables only."""

from difflib import SequenceMatcher


def near_duplicate_removers(rows, threshold=0.85):
    """rows: (id, merchant, amount) in order.  Returns {removed id: keeper id}."""
    kept, removers = [], {}
    for row_id, merchant, amount in sorted(rows):
        name = ("None" if merchant is None else merchant).lower()
        for keeper, keeper_name, keeper_amount in kept:
            alike = SequenceMatcher(None, keeper_name, name).ratio() > threshold
            if alike and abs(keeper_amount - amount) < 0.01:
                removers[row_id] = keeper
                break
        else:
            kept.append((row_id, name, amount))
    return removers
