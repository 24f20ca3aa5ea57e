"""The leak audit.  It imports nothing from the redactor and shares no pattern with it."""
