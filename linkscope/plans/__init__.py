"""How jobs run: fixed points and scratch tables."""
