"""Candlestick patterns as conditions on the current and up to four earlier candles.

``o1`` is the open one bar ago and so on; ``body`` and ``span`` are the mean body and range of the ten bars before,
``mid`` their mean close (above it: an upward context). Codes are 100 (bullish), -100 (bearish) or 0.
"""

_UP, _DOWN = "c > o", "c < o"
_LONG, _LONG1, _LONG2 = "abs(c - o) > body", "abs(c1 - o1) > body", "abs(c2 - o2) > body"
_SHORT1, _SMALL = "abs(c1 - o1) < 0.5 * body", "abs(c - o) < 0.5 * body"
_DOJI = "abs(c - o) <= 0.1 * span"
_UPPER, _LOWER = "(h - greatest(o, c))", "(least(o, c) - l)"
_BULL1, _BEAR1, _BULL2, _BEAR2 = "c1 > o1", "c1 < o1", "c2 > o2", "c2 < o2"


def _when(bull: str | None = None, bear: str | None = None) -> str:
    return " ".join(f"WHEN {x} THEN {code}" for x, code in ((bull, 100), (bear, -100)) if x)


PATTERNS: dict[str, str] = {
    "doji": _when(_DOJI),
    "dragonfly_doji": _when(f"{_DOJI} AND {_UPPER} <= 0.1 * span AND {_LOWER} > 0.1 * span"),
    "gravestone_doji": _when(f"{_DOJI} AND {_LOWER} <= 0.1 * span AND {_UPPER} > 0.1 * span"),
    "long_legged_doji": _when(f"{_DOJI} AND ({_UPPER} > abs(c - o) OR {_LOWER} > abs(c - o))"),
    "engulfing": _when(f"{_UP} AND {_BEAR1} AND c >= o1 AND o <= c1 AND abs(c - o) > abs(c1 - o1)", f"{_DOWN} AND {_BULL1} AND o >= c1 AND c <= o1 AND abs(c - o) > abs(c1 - o1)"),
    "harami": _when(f"{_BEAR1} AND {_LONG1} AND {_SMALL} AND greatest(o, c) < o1 AND least(o, c) > c1", f"{_BULL1} AND {_LONG1} AND {_SMALL} AND greatest(o, c) < c1 AND least(o, c) > o1"),
    "harami_cross": _when(f"{_BEAR1} AND {_LONG1} AND {_DOJI} AND greatest(o, c) < o1 AND least(o, c) > c1", f"{_BULL1} AND {_LONG1} AND {_DOJI} AND greatest(o, c) < c1 AND least(o, c) > o1"),
    "hammer": _when(f"{_SMALL} AND {_LOWER} > 2 * abs(c - o) AND {_UPPER} <= 0.1 * span AND least(o, c) <= l1 + 0.2 * span"),
    "hanging_man": _when(None, f"{_SMALL} AND {_LOWER} > 2 * abs(c - o) AND {_UPPER} <= 0.1 * span AND least(o, c) >= h1 - 0.2 * span"),
    "inverted_hammer": _when(f"{_SMALL} AND {_UPPER} > 2 * abs(c - o) AND {_LOWER} <= 0.1 * span AND greatest(o, c) < least(o1, c1)"),
    "shooting_star": _when(None, f"{_SMALL} AND {_UPPER} > 2 * abs(c - o) AND {_LOWER} <= 0.1 * span AND least(o, c) > greatest(o1, c1)"),
    "marubozu": _when(f"{_UP} AND {_LONG} AND {_UPPER} <= 0.1 * span AND {_LOWER} <= 0.1 * span", f"{_DOWN} AND {_LONG} AND {_UPPER} <= 0.1 * span AND {_LOWER} <= 0.1 * span"),
    "spinning_top": _when(f"{_UP} AND {_SMALL} AND {_UPPER} > abs(c - o) AND {_LOWER} > abs(c - o)", f"{_DOWN} AND {_SMALL} AND {_UPPER} > abs(c - o) AND {_LOWER} > abs(c - o)"),
    "piercing": _when(f"{_BEAR1} AND {_LONG1} AND {_UP} AND {_LONG} AND o < l1 AND c < o1 AND c > (o1 + c1) / 2"),
    "dark_cloud_cover": _when(None, f"{_BULL1} AND {_LONG1} AND {_DOWN} AND o > h1 AND c > o1 AND c < (o1 + c1) / 2"),
    "morning_star": _when(f"{_BEAR2} AND {_LONG2} AND {_SHORT1} AND greatest(o1, c1) < c2 AND {_UP} AND {_LONG} AND c > c2 + 0.3 * (o2 - c2)"),
    "evening_star": _when(None, f"{_BULL2} AND {_LONG2} AND {_SHORT1} AND least(o1, c1) > c2 AND {_DOWN} AND {_LONG} AND c < c2 - 0.3 * (c2 - o2)"),
    "three_white_soldiers": _when(f"{_UP} AND {_BULL1} AND {_BULL2} AND c > c1 AND c1 > c2 AND o > o1 AND o < c1 AND o1 > o2 AND o1 < c2"),
    "three_black_crows": _when(None, f"{_DOWN} AND {_BEAR1} AND {_BEAR2} AND c < c1 AND c1 < c2 AND o < o1 AND o > c1 AND o1 < o2 AND o1 > c2"),
    "three_inside": _when(f"{_BEAR2} AND {_LONG2} AND greatest(o1, c1) < o2 AND least(o1, c1) > c2 AND {_UP} AND c > o2", f"{_BULL2} AND {_LONG2} AND greatest(o1, c1) < c2 AND least(o1, c1) > o2 AND {_DOWN} AND c < o2"),
    "three_outside": _when(f"{_BEAR2} AND {_BULL1} AND c1 > o2 AND o1 < c2 AND c > c1", f"{_BULL2} AND {_BEAR1} AND o1 > c2 AND c1 < o2 AND c < c1"),
    "three_line_strike": _when(f"{_DOWN} AND {_BULL1} AND {_BULL2} AND c3 > o3 AND c1 > c2 AND c2 > c3 AND o > c1 AND c < o3", f"{_UP} AND {_BEAR1} AND {_BEAR2} AND c3 < o3 AND c1 < c2 AND c2 < c3 AND o < c1 AND c > o3"),
    "kicking": _when(f"{_BEAR1} AND {_LONG1} AND {_UP} AND {_LONG} AND l > h1", f"{_BULL1} AND {_LONG1} AND {_DOWN} AND {_LONG} AND h < l1"),
    "belt_hold": _when(f"{_UP} AND {_LONG} AND {_LOWER} <= 0.1 * span", f"{_DOWN} AND {_LONG} AND {_UPPER} <= 0.1 * span"),
    "counterattack": _when(f"{_BEAR1} AND {_LONG1} AND {_UP} AND {_LONG} AND abs(c - c1) <= 0.05 * span", f"{_BULL1} AND {_LONG1} AND {_DOWN} AND {_LONG} AND abs(c - c1) <= 0.05 * span"),
    "homing_pigeon": _when(f"{_BEAR1} AND {_LONG1} AND {_DOWN} AND {_SMALL} AND o < o1 AND c > c1"),
    "matching_low": _when(f"{_BEAR1} AND {_DOWN} AND abs(c - c1) <= 0.05 * span"),
    "on_neck": _when(None, f"{_BEAR1} AND {_LONG1} AND {_UP} AND o < l1 AND abs(c - l1) <= 0.05 * span"),
    "in_neck": _when(None, f"{_BEAR1} AND {_LONG1} AND {_UP} AND o < l1 AND c >= c1 AND c <= c1 + 0.05 * span"),
    "thrusting": _when(None, f"{_BEAR1} AND {_LONG1} AND {_UP} AND o < l1 AND c > c1 + 0.05 * span AND c <= (o1 + c1) / 2"),
    "separating_lines": _when(f"{_BEAR1} AND {_UP} AND {_LONG} AND abs(o - o1) <= 0.05 * span", f"{_BULL1} AND {_DOWN} AND {_LONG} AND abs(o - o1) <= 0.05 * span"),
    "two_crows": _when(None, f"{_BULL2} AND {_LONG2} AND {_BEAR1} AND c1 > c2 AND {_DOWN} AND o < o1 AND o > c1 AND c > o2 AND c < c2"),
    "stick_sandwich": _when(f"{_BEAR2} AND {_BULL1} AND {_DOWN} AND l1 > c2 AND abs(c - c2) <= 0.05 * span"),
    "tri_star": _when("abs(c - o) <= 0.1 * span AND abs(c1 - o1) <= 0.1 * span AND abs(c2 - o2) <= 0.1 * span AND greatest(o1, c1) < least(o2, c2)", "abs(c - o) <= 0.1 * span AND abs(c1 - o1) <= 0.1 * span AND abs(c2 - o2) <= 0.1 * span AND least(o1, c1) > greatest(o2, c2)"),
    "rising_falling_three": _when("c4 > o4 AND c > o AND c > c4 AND h3 < h4 AND h2 < h4 AND h1 < h4 AND l3 > l4 AND l2 > l4 AND l1 > l4", "c4 < o4 AND c < o AND c < c4 AND h3 < h4 AND h2 < h4 AND h1 < h4 AND l3 > l4 AND l2 > l4 AND l1 > l4"),
    # Patterns of one candle.
    "closing_marubozu": _when(f"{_UP} AND {_LONG} AND {_UPPER} <= 0.1 * span", f"{_DOWN} AND {_LONG} AND {_LOWER} <= 0.1 * span"),
    "high_wave": _when(f"{_UP} AND {_SMALL} AND {_UPPER} > 2 * abs(c - o) AND {_LOWER} > 2 * abs(c - o)", f"{_DOWN} AND {_SMALL} AND {_UPPER} > 2 * abs(c - o) AND {_LOWER} > 2 * abs(c - o)"),
    "long_line": _when(f"{_UP} AND {_LONG} AND {_UPPER} < 0.5 * abs(c - o) AND {_LOWER} < 0.5 * abs(c - o)", f"{_DOWN} AND {_LONG} AND {_UPPER} < 0.5 * abs(c - o) AND {_LOWER} < 0.5 * abs(c - o)"),
    "short_line": _when(f"{_UP} AND {_SMALL} AND {_UPPER} < 0.25 * span AND {_LOWER} < 0.25 * span", f"{_DOWN} AND {_SMALL} AND {_UPPER} < 0.25 * span AND {_LOWER} < 0.25 * span"),
    "rickshaw_man": _when(f"{_DOJI} AND {_UPPER} > 2 * abs(c - o) AND {_LOWER} > 2 * abs(c - o) AND least(o, c) <= (h + l) / 2 + 0.1 * span AND greatest(o, c) >= (h + l) / 2 - 0.1 * span"),
    "takuri": _when(f"{_DOJI} AND {_UPPER} <= 0.1 * span AND {_LOWER} > 2 * abs(c - o) AND {_LOWER} > 0.5 * span"),
    # Of two candles.
    "doji_star": _when(f"{_BEAR1} AND {_LONG1} AND {_DOJI} AND greatest(o, c) < c1", f"{_BULL1} AND {_LONG1} AND {_DOJI} AND least(o, c) > c1"),
    "kicking_by_length": _when(*(f"(({_BEAR1} AND {_UP} AND l > h1) OR ({_BULL1} AND {_DOWN} AND h < l1)) AND {_LONG} AND {_LONG1} AND {_UPPER} <= 0.1 * span AND {_LOWER} <= 0.1 * span AND h1 - greatest(o1, c1) <= 0.1 * span AND least(o1, c1) - l1 <= 0.1 * span AND CASE WHEN abs(c - o) > abs(c1 - o1) THEN {a} ELSE {b} END" for a, b in ((_UP, _BULL1), (_DOWN, _BEAR1)))),
    # Of three candles.
    "three_stars_in_south": _when(f"{_BEAR2} AND {_BEAR1} AND {_DOWN} AND {_LONG2} AND least(o2, c2) - l2 > abs(c2 - o2) AND abs(c1 - o1) < abs(c2 - o2) AND o1 > c2 AND o1 <= h2 AND l1 < c2 AND l1 >= l2 AND {_SMALL} AND {_UPPER} <= 0.1 * span AND {_LOWER} <= 0.1 * span AND l > l1 AND h < h1"),
    "abandoned_baby": _when(f"{_BEAR2} AND {_LONG2} AND abs(c1 - o1) <= 0.1 * span AND h1 < l2 AND {_UP} AND NOT {_SMALL} AND l > h1 AND c > c2 + 0.3 * (o2 - c2)", f"{_BULL2} AND {_LONG2} AND abs(c1 - o1) <= 0.1 * span AND l1 > h2 AND {_DOWN} AND NOT {_SMALL} AND h < l1 AND c < c2 - 0.3 * (c2 - o2)"),
    "advance_block": _when(None, f"{_BULL2} AND {_BULL1} AND {_UP} AND c > c1 AND c1 > c2 AND o1 > o2 AND o1 <= c2 + 0.2 * span AND o > o1 AND o <= c1 + 0.2 * span AND {_LONG2} AND abs(c1 - o1) < abs(c2 - o2) AND abs(c - o) < abs(c1 - o1) AND ({_UPPER} > abs(c - o) OR h1 - c1 > abs(c1 - o1))"),
    "evening_doji_star": _when(None, f"{_BULL2} AND {_LONG2} AND abs(c1 - o1) <= 0.1 * span AND least(o1, c1) > c2 AND {_DOWN} AND NOT {_SMALL} AND c < c2 - 0.3 * (c2 - o2)"),
    "morning_doji_star": _when(f"{_BEAR2} AND {_LONG2} AND abs(c1 - o1) <= 0.1 * span AND greatest(o1, c1) < c2 AND {_UP} AND NOT {_SMALL} AND c > c2 + 0.3 * (o2 - c2)"),
    "gap_side_side_white": _when(f"least(o1, c1) > greatest(o2, c2) AND least(o, c) > greatest(o2, c2) AND {_BULL1} AND {_UP} AND abs(abs(c - o) - abs(c1 - o1)) <= 0.2 * span AND abs(o - o1) <= 0.05 * span", f"greatest(o1, c1) < least(o2, c2) AND greatest(o, c) < least(o2, c2) AND {_BULL1} AND {_UP} AND abs(abs(c - o) - abs(c1 - o1)) <= 0.2 * span AND abs(o - o1) <= 0.05 * span"),
    "hikkake": _when("h1 < h2 AND l1 > l2 AND h < h1 AND l < l1", "h1 < h2 AND l1 > l2 AND h > h1 AND l > l1"),
    "identical_three_crows": _when(None, f"{_BEAR2} AND {_BEAR1} AND {_DOWN} AND c1 < c2 AND c < c1 AND abs(o1 - c2) <= 0.05 * span AND abs(o - c1) <= 0.05 * span AND least(o2, c2) - l2 <= 0.1 * span AND least(o1, c1) - l1 <= 0.1 * span AND {_LOWER} <= 0.1 * span"),
    "stalled_pattern": _when(None, f"{_BULL2} AND {_BULL1} AND {_UP} AND c > c1 AND c1 > c2 AND {_LONG2} AND {_LONG1} AND h1 - c1 <= 0.1 * span AND o1 > o2 AND o1 <= c2 + 0.2 * span AND {_SMALL} AND o >= c1 - abs(c - o) - 0.2 * span"),
    "tasuki_gap": _when(f"least(o1, c1) > greatest(o2, c2) AND {_BULL1} AND {_DOWN} AND o < c1 AND o > o1 AND c < o1 AND c > greatest(o2, c2) AND abs(abs(c1 - o1) - abs(c - o)) <= 0.2 * span", f"greatest(o1, c1) < least(o2, c2) AND {_BEAR1} AND {_UP} AND o < o1 AND o > c1 AND c > o1 AND c < least(o2, c2) AND abs(abs(c1 - o1) - abs(c - o)) <= 0.2 * span"),
    "unique_three_river": _when(f"{_BEAR2} AND {_LONG2} AND {_BEAR1} AND c1 > c2 AND o1 <= o2 AND l1 < l2 AND {_UP} AND {_SMALL} AND o > l1"),
    "upside_gap_two_crows": _when(None, f"{_BULL2} AND {_LONG2} AND {_BEAR1} AND {_SHORT1} AND c1 > c2 AND {_DOWN} AND o > o1 AND c < c1 AND c > c2"),
    "gap_three_methods": _when(f"{_BULL2} AND {_BULL1} AND least(o1, c1) > greatest(o2, c2) AND {_DOWN} AND o < c1 AND o > o1 AND c < c2 AND c > o2", f"{_BEAR2} AND {_BEAR1} AND greatest(o1, c1) < least(o2, c2) AND {_UP} AND o < o1 AND o > c1 AND c < o2 AND c > c2"),
    # Of four and five candles.
    "hikkake_modified": _when("h2 < h3 AND l2 > l3 AND h1 < h2 AND l1 > l2 AND c2 <= l2 + (h2 - l2) * 0.2 AND h < h1 AND l < l1", "h2 < h3 AND l2 > l3 AND h1 < h2 AND l1 > l2 AND c2 >= h2 - (h2 - l2) * 0.2 AND h > h1 AND l > l1"),
    "concealing_baby_swallow": _when(f"c3 < o3 AND {_BEAR2} AND {_BEAR1} AND {_DOWN} AND h3 - o3 <= 0.1 * span AND c3 - l3 <= 0.1 * span AND h2 - o2 <= 0.1 * span AND c2 - l2 <= 0.1 * span AND o1 < c2 AND h1 - o1 > 0.1 * span AND h1 > c2 AND h > h1 AND l < l1"),
    "breakaway": _when(f"c4 < o4 AND abs(c4 - o4) > body AND c3 < o3 AND o3 < c4 AND h2 < h3 AND l2 < l3 AND {_BEAR1} AND h1 < h2 AND l1 < l2 AND {_UP} AND c > o3 AND c < c4", f"c4 > o4 AND abs(c4 - o4) > body AND c3 > o3 AND o3 > c4 AND h2 > h3 AND l2 > l3 AND {_BULL1} AND h1 > h2 AND l1 > l2 AND {_DOWN} AND c < o3 AND c > c4"),
    "ladder_bottom": _when(f"c4 < o4 AND c3 < o3 AND {_BEAR2} AND o4 > o3 AND o3 > o2 AND c4 > c3 AND c3 > c2 AND {_BEAR1} AND h1 - o1 > 0.1 * span AND {_UP} AND o > o1 AND c > h1"),
    "mat_hold": _when(f"c4 > o4 AND abs(c4 - o4) > body AND c3 < o3 AND least(o3, c3) > c4 AND greatest(o2, c2) < o3 AND greatest(o1, c1) < greatest(o2, c2) AND least(o2, c2) > c4 - 0.5 * (c4 - o4) AND least(o1, c1) > c4 - 0.5 * (c4 - o4) AND {_UP} AND o > c1 AND c > greatest(h3, h2, h1)"),
}
