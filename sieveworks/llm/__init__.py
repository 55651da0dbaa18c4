"""Operators of a training-data pipeline: quality, secrets, near duplicates, URL rules, chat, lines, search, mixing, rules, tokens, repair, runs."""
