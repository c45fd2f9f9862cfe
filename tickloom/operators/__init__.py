"""Operators on bars, signals, trades, combinations, votes and funds."""
