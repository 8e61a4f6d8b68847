"""Model-sized work on the driver: graphs, cuts, trees, sessions."""
