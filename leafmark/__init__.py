"""leafmark: analytics over digitised, paginated text as DataFrame operators."""
