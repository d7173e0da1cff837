"""The hourly cycle (B1), stand-in tables, the registered query catalog, its SQL oracle and SQL views."""
