"""Where catalogues come from and where selections go."""
