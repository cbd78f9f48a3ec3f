from gapline.functions.clock import cell, day_us, from_micros, hour_us, micros, minute_us, second_us
