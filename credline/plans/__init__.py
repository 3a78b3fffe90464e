"""Query plans over the driver tables: adapter views, queries and their SQL oracles."""
