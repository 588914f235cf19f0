"""Where records come from and where reports go."""
