"""Column functions: ATT&CK maps, identities, times and text."""
