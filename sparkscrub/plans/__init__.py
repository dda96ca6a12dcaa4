"""Cleaning recipes, their audit, and the one-call automatic cleaning."""
