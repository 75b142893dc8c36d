"""Planning, outcome, budgets and evaluation."""
