"""Where the lending tables come from and where results go."""
