"""What licence scans look for."""

# Phrases of the base labels.
BASE_PHRASES = (
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("general public license", "gpl"),
)

# Sentences of common licences and of their notices, the label each gives, and its mandatory phrases.
# Terms are lower-cased runs of letters and digits; a mandatory phrase stands inside the sentence.
TEMPLATES = (
    ("released under the mit license", "notice:mit", ("under the mit license",)),
    ("licensed under the mit license", "notice:mit", ("under the mit license",)),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "text:mit", ("permission is hereby granted", "without restriction")),
    ("the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "text:mit", ("this permission notice",)),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "text:isc", ("with or without fee is hereby granted",)),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "text:bsd", ("source and binary forms",)),
    ("redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "text:bsd", ("redistributions in binary form",)),
    ("neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "text:bsd-3-clause", ("nor the names of its contributors",)),
    ("licensed under the apache license version 2 0", "notice:apache-2.0", ("apache license version 2 0",)),
    ("you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "text:apache-2.0", ("apache org licenses license 2 0",)),
    ("subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license", "text:apache-2.0", ("non exclusive no charge royalty free irrevocable",)),
    ("this work is licensed under the gnu general public license version 2", "notice:gpl-2.0", ("general public license version 2",)),
    ("this work is licensed under the gnu general public license version 3", "notice:gpl-3.0", ("general public license version 3",)),
    ("it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "notice:gpl-2.0-or-later", ("gnu general public license", "version 2 of the license")),
    ("it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "notice:gpl-3.0-or-later", ("gnu general public license", "version 3 of the license")),
    ("the gnu general public license is a free copyleft license for software and other kinds of works", "text:gpl-3.0", ("free copyleft license",)),
    ("everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed", "text:gnu", ("verbatim copies of this license document",)),
    ("it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version", "notice:lgpl-2.1-or-later", ("gnu lesser general public license", "version 2 1 of the license")),
    ("it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version", "notice:lgpl-3.0-or-later", ("gnu lesser general public license", "version 3 of the license")),
    ("it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version", "notice:agpl-3.0-or-later", ("gnu affero general public license", "version 3 of the license")),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "notice:mpl-2.0", ("mozilla public license v 2 0",)),
    ("if a copy of the mpl was not distributed with this file you can obtain one at", "notice:mpl", ("copy of the mpl",)),
    ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "notice:epl-2.0", ("eclipse public license 2 0",)),
    ("this is free and unencumbered software released into the public domain", "text:unlicense", ("released into the public domain",)),
    ("anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means", "text:unlicense", ("in source code form or as a compiled binary",)),
    ("to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "notice:cc0-1.0", ("waived all copyright and related or neighboring rights",)),
    ("licensed under a creative commons attribution 4 0 international license", "notice:cc-by-4.0", ("creative commons attribution 4 0",)),
    ("licensed under cc by 4 0", "notice:cc-by-4.0", ("licensed under cc by 4 0",)),
    ("licensed under cc by sa 4 0", "notice:cc-by-sa-4.0", ("licensed under cc by sa 4 0",)),
    ("licensed under cc by nc 4 0", "notice:cc-by-nc-4.0", ("licensed under cc by nc 4 0",)),
    ("all rights reserved", "notice:all-rights-reserved", ("all rights reserved",)),
    ("spdx license identifier mit", "spdx:mit", ("spdx license identifier mit",)),
    ("spdx license identifier isc", "spdx:isc", ("spdx license identifier isc",)),
    ("spdx license identifier apache 2 0", "spdx:apache-2.0", ("spdx license identifier apache 2 0",)),
    ("spdx license identifier bsd 2 clause", "spdx:bsd-2-clause", ("spdx license identifier bsd 2 clause",)),
    ("spdx license identifier bsd 3 clause", "spdx:bsd-3-clause", ("spdx license identifier bsd 3 clause",)),
    ("spdx license identifier gpl 2 0", "spdx:gpl-2.0", ("spdx license identifier gpl 2 0",)),
    ("spdx license identifier gpl 3 0", "spdx:gpl-3.0", ("spdx license identifier gpl 3 0",)),
    ("spdx license identifier lgpl 2 1", "spdx:lgpl-2.1", ("spdx license identifier lgpl 2 1",)),
    ("spdx license identifier agpl 3 0", "spdx:agpl-3.0", ("spdx license identifier agpl 3 0",)),
    ("spdx license identifier mpl 2 0", "spdx:mpl-2.0", ("spdx license identifier mpl 2 0",)),
    ("spdx license identifier epl 2 0", "spdx:epl-2.0", ("spdx license identifier epl 2 0",)),
    ("spdx license identifier cc0 1 0", "spdx:cc0-1.0", ("spdx license identifier cc0 1 0",)),
    ("spdx license identifier unlicense", "spdx:unlicense", ("spdx license identifier unlicense",)),
)
