"""How series operators become DataFrame plans."""
