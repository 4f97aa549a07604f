"""DataFrame -> DataFrame operators: cleaning, features, rules, scoring, scrubbing, ledger, learning."""
