"""wordloom: approximate dictionary search as DataFrame plans."""
