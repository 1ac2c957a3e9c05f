"""Where memory graphs come from and go to."""
