"""DataFrame operators: calendar, point-in-time, returns, signals, orders and ledger."""
