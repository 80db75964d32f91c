"""Notices of licences: what the classifier of ``license_scan`` is trained on and compares with."""

from __future__ import annotations

# Opening words and short forms of public licences, by family
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "Apache License, Version 2.0",
    ),
    "MIT": (
        "Released under the MIT License.",
        "This project is licensed under the MIT License - see the LICENSE file for details.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
        "The MIT License",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see http://www.gnu.org/licenses/.",
        "GNU General Public License",
        "GNU GPL v3",
        "Released under the GPL v2 or later",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
        "GNU Lesser General Public License",
        "GNU LGPL v2.1",
    ),
    "AGPL": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "Licensed under the GNU Affero General Public License, version 3.",
        "GNU Affero General Public License",
        "GNU AGPL v3",
    ),
    "BSD": (
        "Licensed under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "BSD 3-Clause License",
        "BSD 2-Clause License",
    ),
    "ISC": (
        "Licensed under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "The ISC License",
    ),
    "BSL-1.0": (
        "Distributed under the Boost Software License, Version 1.0.",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
        "Boost Software License",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Mozilla Public License",
    ),
    "EPL": (
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License v1.0.",
        "Eclipse Public License",
    ),
    "Zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "Licensed under the zlib License.",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "CC BY 4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "CC BY-SA 4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "CC BY-NC 4.0",
    ),
    "CC-BY-ND": (
        "Licensed under CC BY-ND 4.0.",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
        "CC BY-ND 4.0",
    ),
    "public domain": (
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Dedicated to the public domain under CC0 1.0.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "No part of this book may be reproduced or transmitted in any form or by any means, electronic or mechanical, without written permission from the publisher.",
        "This document is proprietary and confidential. Unauthorized copying of this file, via any medium, is strictly prohibited.",
        "All rights reserved.",
    ),
}

# Identifiers of the families' licences in file headers
IDENTIFIERS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": ("Apache-2.0",), "MIT": ("MIT",), "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only"), "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "BSD": ("BSD-2-Clause", "BSD-3-Clause"),
    "ISC": ("ISC",), "BSL-1.0": ("BSL-1.0",), "MPL-2.0": ("MPL-2.0",), "EPL": ("EPL-1.0", "EPL-2.0"), "Zlib": ("Zlib",), "CC-BY": ("CC-BY-4.0",),
    "CC-BY-SA": ("CC-BY-SA-4.0",), "CC-BY-NC": ("CC-BY-NC-4.0",), "CC-BY-ND": ("CC-BY-ND-4.0",), "public domain": ("CC0-1.0", "Unlicense"),
}

# Text that is no notice of a family above. Other licences and plain
# sentences of the same vocabulary; the first list is learned from, the second sets the limit.
UNKNOWN_LEARNED = (
    "Licensed under the Common Development and Distribution License, Version 1.0.",
    "This file is part of the project and is subject to the terms and conditions in its LICENSE file.",
    "Permission to use this software and its documentation is granted under the PostgreSQL Licence.",
    "Use, modification and distribution are subject to the Artistic License.",
    "He renewed his driver's license at the office and paid the fee.",
    "The teacher gave the children permission to leave the room early.",
    "You need written permission from the landlord before you keep a dog.",
    "The city council reserved the right to change the plan.",
    "The software was slow, so the team wrote a new version of the program.",
    "Public opinion on the general election was divided between the two parties.",
    "The company sells its products under a new name in several countries.",
    "Copyright law protects the authors of books and songs for many years.",
    "A copy of the report was sent to every person in the department.",
    "The license fee for television was raised again last year.",
    "Please read the terms of the agreement before you sign it.",
    "The warranty covers parts and labour for two years from the date of purchase.",
    "The library is open to the public from nine to five.",
    "The document was distributed to all members free of charge.",
    "She asked for a free copy of the source and was given one.",
    "The rights of workers were discussed in the third part of the conference.",
)
UNKNOWN_HELD = (
    "This Font Software is licensed under the SIL Open Font License, Version 1.1.",
    "Licensed under the European Union Public Licence.",
    "Distributed under the terms of the Sleepycat License.",
    "This software is released under the Vim License.",
    "The council granted a licence to the new restaurant on the corner.",
    "No permission was needed to take photographs in the museum.",
    "All seats in the front rows are reserved for members of the club.",
    "The source of the river is a small spring in public land.",
    "The program of the concert was printed in two versions.",
    "Free software is a matter of liberty, said the speaker in his talk.",
    "The company provides its customers with a limited warranty.",
    "The publisher printed a second edition of the book in the following year.",
    "The general terms of the contract are published on our site.",
    "Redistribution of wealth was the main subject of the debate.",
    "A license plate with the number was found near the domain of the duke.",
    "Copying machines were provided in every public library.",
)


def rows() -> list[tuple[str, str]]:
    """(family, notice): every notice, and a header with each identifier."""
    headers = [(f, f"SPDX-License-Identifier: {x}") for f, names in IDENTIFIERS.items() for x in names]
    return [(f, n) for f, notices in NOTICES.items() for n in notices] + headers
