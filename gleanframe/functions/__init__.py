"""Column-level helpers: null rules, text cleaning, distribution tails."""
