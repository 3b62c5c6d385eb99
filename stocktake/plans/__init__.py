"""Change plans as tables; nothing is executed."""
