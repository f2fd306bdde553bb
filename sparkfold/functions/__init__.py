"""Part of sparkfold."""
