"""Forward-looking operators: scenarios, monthly plans, budgets, rules, plan tables."""
