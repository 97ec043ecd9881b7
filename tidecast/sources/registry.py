"""The published unit list, event list and expected patterns."""

# Units by vertical.
VERTICALS: dict[str, list[str]] = {
    "Technology": [
        "Python_(programming_language)", "Artificial_intelligence", "ChatGPT", "IPhone", "Google",
        "Microsoft", "Tesla,_Inc.",
    ],
    "Sports": ["NFL", "NBA", "Super_Bowl", "Premier_League", "LeBron_James", "UFC"],
    "Entertainment": [
        "Taylor_Swift", "Netflix", "YouTube", "Barbie_(film)", "Oppenheimer_(film)", "Beyonce", "Spotify",
    ],
    "Finance": [
        "Bitcoin", "Stock_market", "Federal_Reserve", "Amazon_(company)", "Apple_Inc.", "Inflation", "S&P_500",
    ],
    "Health": ["Mental_health", "Ozempic", "Cancer", "Diabetes", "Exercise", "Influenza", "Sleep"],
}

# Known events as unit -> (date, name, category).
EVENTS: dict[str, list[tuple[str, str, str]]] = {
    "Taylor_Swift": [
        ("2023-03-17", "Eras Tour kickoff", "Entertainment Release"),
        ("2023-07-22", "Eras Tour film announcement", "Entertainment Release"),
        ("2024-02-04", "Super Bowl LVIII attendance", "Sports Event"),
    ],
    "NFL": [
        ("2023-02-12", "Super Bowl LVII (Chiefs vs Eagles)", "Sports Event"),
        ("2023-09-07", "2023 season kickoff", "Sports Event"),
        ("2024-02-11", "Super Bowl LVIII (Chiefs vs 49ers)", "Sports Event"),
        ("2024-09-05", "2024 season kickoff", "Sports Event"),
    ],
    "Bitcoin": [
        ("2024-01-10", "Bitcoin ETF approval", "Viral-Unpredictable"),
        ("2024-03-14", "All-time high $73K", "Viral-Unpredictable"),
        ("2024-04-19", "Bitcoin halving", "Viral-Unpredictable"),
    ],
    "Super_Bowl": [
        ("2023-02-12", "Super Bowl LVII", "Sports Event"),
        ("2024-02-11", "Super Bowl LVIII", "Sports Event"),
    ],
    "Barbie_(film)": [
        ("2023-07-21", "Theatrical release", "Entertainment Release"),
        ("2023-07-22", "Opening weekend peak", "Entertainment Release"),
    ],
    "Oppenheimer_(film)": [("2023-07-21", "Theatrical release (Barbenheimer)", "Entertainment Release")],
    "ChatGPT": [
        ("2023-03-14", "GPT-4 release", "Viral-Unpredictable"),
        ("2023-11-06", "GPT-4 Turbo announcement", "Viral-Unpredictable"),
    ],
    "Ozempic": [("2023-06-01", "Celebrity weight loss coverage peaks", "Viral-Unpredictable")],
    "Influenza": [
        ("2023-01-15", "Winter peak 2023", "Seasonal"),
        ("2024-01-15", "Winter peak 2024", "Seasonal"),
    ],
    "IPhone": [
        ("2023-09-12", "iPhone 15 announcement", "Product Launch"),
        ("2023-09-22", "iPhone 15 release", "Product Launch"),
    ],
    "Apple_Inc.": [
        ("2023-09-12", "iPhone 15 announcement", "Product Launch"),
        ("2023-06-05", "WWDC 2023 (Vision Pro)", "Product Launch"),
    ],
}

# The pattern expected of each checked unit.
EXPECTED_PATTERNS = {
    "Python_(programming_language)": "weekend_dip",
    "NFL": "weekly_swing",
    "Bitcoin": "strong_weekend_dip",
    "Influenza": "yearly_swing",
    "Taylor_Swift": "manual",
}
