"""Sources and stores: the activity generator, the change-log data source, offset stores."""
