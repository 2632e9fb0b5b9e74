"""Calendar-aligned market, event and text analytics as DataFrame-in, DataFrame-out operators."""
