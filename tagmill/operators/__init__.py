"""The three commands, and extensions beyond them."""
